"""Trackers against versions that follow a whole recording frame by frame."""

import itertools

import numpy as np
import pytest

from strandline.operators import linking

SCHEMA = "recording_id string, frame int, label int, cy double, cx double, area_px long"


def detections(seed, size, frames=40, per=6, empty=0.3):
    rng = np.random.default_rng(seed)
    rows = []
    for rec in ("a", "b", "c"):
        for f in range(frames):
            n = 0 if rng.random() < empty else int(rng.integers(0, per))
            rows += [(rec, f, k, float(y), float(x), int(rng.integers(50, 60))) for k, (y, x) in enumerate(rng.random((n, 2)) * size)]
    return rows


def whole(rows, hop, max_gap, spawn):
    """Track of every detection, from one matrix of all live tracks and points of a frame."""
    out = {}
    for rec in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == rec)
        live, free, first = {}, 0, True
        for f, group in itertools.groupby(own, key=lambda r: r[1]):
            group = list(group)
            owner, free = linking.step_tracks(live, f, np.array([r[3:5] for r in group]), hop, max_gap, spawn or first, free)
            out |= {(rec, f, r[2]): t for r, t in zip(group, owner) if t >= 0}
            first = False
    return out


@pytest.mark.parametrize("spawn", [True, False])
@pytest.mark.parametrize("size", [60.0, 400.0, 2000.0])
def test_components_track_as_the_whole(spark, size, spawn):
    rows = detections(int(size), size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["recording_id"], r["frame"], r["label"]): r["track_id"] for r in linking.track_assign(df, 20.0, 5, spawn).collect()}
    want = whole(rows, 20.0, 5, spawn)
    assert got == want and len(want) >= 3
    if spawn:
        long = linking.track_assign(df, 20.0, 5, spawn, min_length=3).collect()
        sizes = {}
        for (rec, _, _), t in want.items():
            sizes[rec, t] = sizes.get((rec, t), 0) + 1
        assert {(r["recording_id"], r["frame"], r["label"]): r["track_id"] for r in long} == {k: t for k, t in want.items() if sizes[k[0], t] >= 3}


def test_empty_tables_have_no_tracks(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linking.track_assign(none).count() == 0 and linking.anchor_single(none).count() == 0


def test_sparse_matching_is_optimal():
    rng = np.random.default_rng(8)
    for _ in range(200):
        edges = [(int(t), int(p), float(d)) for (t, p), d in {(int(t), int(p)): d for t, p, d in zip(rng.integers(0, 5, 8), rng.integers(0, 5, 8), rng.random(8))}.items() for t, p in [(t, p)]]
        cost = {(t, p): d for t, p, d in edges}
        best = max(((len(c), -sum(cost[e] for e in c)) for k in range(6) for c in itertools.combinations(cost, k) if len({t for t, _ in c}) == len({p for _, p in c}) == k))
        got = linking.match_sparse(edges)
        assert len({t for t, _ in got}) == len({p for _, p in got}) == len(got) == best[0] and abs(sum(cost[e] for e in got) + best[1]) < 1e-9


@pytest.mark.parametrize("size,empty", [(60.0, 0.3), (300.0, 0.3), (900.0, 0.0), (900.0, 0.9)])
def test_anchor_chain(spark, size, empty):
    rows = detections(int(size) + 1, size, frames=70, empty=empty)
    want = set()
    for rec in sorted({r[0] for r in rows}):
        at = None
        for f, group in itertools.groupby(sorted(r for r in rows if r[0] == rec), key=lambda r: r[1]):
            group = list(group)
            if at is None:
                pick = min(group, key=lambda r: (-r[5], r[2]))
            else:
                d, k = min((np.hypot(r[3] - at[3], r[4] - at[4]), r[2]) for r in group)
                pick = next(r for r in group if r[2] == k) if d <= 80 else None
            if pick:
                want.add(pick[:3])
                at = pick
    got = {(r["recording_id"], r["frame"], r["label"]) for r in linking.anchor_single(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_stream_with_late_rows_and_dead_tracks(spark):
    """The replay equals the whole-recording version; late rows, appended last, change nothing."""
    from strandline.streaming import sessions
    rng = np.random.default_rng(5)
    rows = [("a", f, 0, 10.0 + f, 10.0, 5) for f in range(60) if not 20 <= f < 33] + [("a", f, 1, 500.0 + float(rng.random()), 80.0, 5) for f in range(0, 60, 5)]
    rows += [("b", f, 0, 5.0, 5.0 + f, 5) for f in (0, 3, 14, 26, 38)]
    want = whole(rows, 20.0, linking.MAX_GAP, True)
    assert len({t for (r, _, _), t in want.items() if r == "a"}) == 3 and len({t for (r, _, _), t in want.items() if r == "b"}) == 3
    late = [("a", 7, 5, 0.0, 0.0, 5), ("b", 2, 5, 5.0, 5.0, 5), ("a", 58, 5, 900.0, 900.0, 5)]
    stamped = lambda r: sessions.event_time(spark.createDataFrame(r, SCHEMA))
    with sessions.rocksdb(spark):
        out = sessions._replay(stamped(rows), sessions.tracker, slices=3, closing=stamped(late)).collect()
    assert {(r["recording_id"], r["frame"], r["label"]): r["track_id"] for r in out} == want
