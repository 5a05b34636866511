"""The tracker of crowded frames (F7)."""

import tracemalloc

import numpy as np
import pytest
from test_tracking import SCHEMA, whole

from strandline.operators import linking, matching


def test_a_frame_makes_no_matrix():
    """2,000 tracks far from each other: only pairs within reach are made."""
    at = np.stack([np.arange(2000) % 7 * 1.0, np.arange(2000) * 50.0], 1)
    live = {}
    owner, free = linking.step_tracks(live, 0, at, 20.0, 11, True, 0)
    tracemalloc.start()
    again, _ = linking.step_tracks(live, 1, at + 3.0, 20.0, 11, True, free)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again == owner and peak < 8 << 20


def crowd(seed, copies, recordings=("a", "b"), frames=9):
    """Places on a coarse grid, each of them several times, so that many matchings are equally good."""
    rng = np.random.default_rng(seed)
    rows = []
    for rec in recordings:
        for f in range(frames):
            at = [(float(y), float(5 * x)) for y, x in rng.integers(0, 20, (int(rng.integers(4, 12)), 2))] * copies
            rows += [(rec, f, k, y, x, 50) for k, (y, x) in enumerate(at)]
    return rows


@pytest.mark.parametrize("copies", [1, 4])
def test_stream_and_batch_agree_on_ties(spark, copies):
    rows = crowd(copies, copies)
    for hop in (6.0, 20.0):
        got = {(r["recording_id"], r["frame"], r["label"]): r["track_id"] for r in linking.track_assign(spark.createDataFrame(rows, SCHEMA).repartition(3), hop, 3).collect()}
        assert got == whole(rows, hop, 3, True)


def test_flows_between_places_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        room, supply = rng.integers(1, 4, n).tolist(), rng.integers(1, 4, m).tolist()
        near, allowed = rng.integers(0, 9, (n, m)) * 0.5, rng.random((n, m)) < 0.5
        i, j = np.nonzero(allowed)
        got = matching.cheapest(i, j, near[i, j], room, supply)
        t, p = np.repeat(np.arange(n), room), np.repeat(np.arange(m), supply)
        wide, dense = near[np.ix_(t, p)], linking.match(near[np.ix_(t, p)], allowed[np.ix_(t, p)])
        assert all(allowed[i, j] and k > 0 for i, j, k in got)
        assert all(sum(k for a, _, k in got if a == i) <= room[i] for i in range(n)) and all(sum(k for _, b, k in got if b == j) <= supply[j] for j in range(m))
        assert sum(k for _, _, k in got) == len(dense) and np.isclose(sum(k * near[i, j] for i, j, k in got), sum(wide[a, b] for a, b in dense))


def test_pairs_within_reach(monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 7)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, (40, 2)).astype(float), rng.integers(0, 30, (50, 2)).astype(float)
    a[3], b[5] = np.nan, np.nan
    reach = rng.integers(1, 4, 40) * 5.0
    got = [(int(i), int(j)) for c in matching.pairs_within(*a.T, reach, *b.T) for i, j in zip(*c[:2])]
    want = [(i, j) for i in range(40) for j in range(50) if np.sqrt(((a[i] - b[j]) ** 2).sum()) <= reach[i]]
    assert sorted(got) == want and len(got) == len(set(got))
