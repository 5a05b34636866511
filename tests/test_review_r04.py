"""Findings of the fourth review."""

import math

import numpy as np
from test_tracking import SCHEMA

from strandline.operators import linking
from strandline.streaming import sessions

POINTS = "recording_id string, track_id long, frame int, cy double, cx double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near_ties(n):
    """Pairs of places next to each other of which the nearer to the origin (the first among equals) is another by pow(x, 2) than by products."""
    rng, out = np.random.default_rng(0), []
    first = lambda square, at: min((math.sqrt(square(y) + square(x)), k) for k, (y, x) in enumerate(at))[1]
    while len(out) < n:
        y, x = rng.uniform(1, 30, 2).tolist()
        at = [(y, x), (float(np.nextafter(y, 0)), x)]
        if first(lambda v: math.pow(v, 2.0), at) != first(lambda v: v * v, at):
            out.append((at, first(lambda v: math.pow(v, 2.0), at)))
    return out


def test_near_ties_fall_as_by_pow(spark):
    """the SQL's squares are pow(x, 2), which some products differ from."""
    cases = near_ties(6)
    det = spark.createDataFrame([("a", 2 * f + 1, k, y, x, 50) for f, (at, _) in enumerate(cases) for k, (y, x) in enumerate(at)], SCHEMA)
    ends = [(0.0, 0.0), (None, None), (0.0, 0.0)]
    points = spark.createDataFrame([("a", t, 2 * t + k, y, x) for t in range(len(cases)) for k, (y, x) in enumerate(ends)], POINTS)
    found = linking.nearest_detection(linking.interpolate_centroid(points), det, 60.0)
    want = {t: k for t, (_, k) in enumerate(cases)}
    assert {r["track_id"]: r["label"] for r in found.collect()} == want
    filled = {r["track_id"]: (r["cy"], r["cx"]) for r in linking.fill_track_gaps(points, det, 60.0).where("is_filled").collect()}
    assert filled == {t: cases[t][0][k] for t, k in want.items()}


def test_detections_are_not_joined_one_by_one(spark):
    """300 detections at a place are one, and no pair of a point and a detection is sorted or shuffled."""
    det = spark.createDataFrame([("a", 0, k, float(k % 3), 0.0, 50 + k) for k in range(900)], SCHEMA)
    points = spark.createDataFrame([("a", t, 0, float(t % 3), 1.0) for t in range(90)], POINTS)
    found = linking.nearest_detection(points, det, 60.0, 100)
    near = {0: (51, 101, 1.0), 1: (52, 102, 1.0), 2: (50, 100, 1.0)}
    assert {r["track_id"]: (r["label"], r["area_px"], r["dist"]) for r in found.collect()} == {t: near[t % 3] for t in range(90)}
    assert "SortMergeJoin" not in plan(found) and linking.nearest_detection(points, det, 1.0, 100).count() == 0


def test_candidates_are_not_multiplied_by_gaps(spark):
    """places are sent to squares and blocks of frames, not to every gap; all pairs are there."""
    rng = np.random.default_rng(3)
    rows = [("a", int(f), k, float(y), float(x), 50) for k, (f, y, x) in enumerate(zip(rng.integers(-3, 25, 300), rng.integers(-30, 30, 300) * 5, rng.integers(-30, 30, 300) * 5))]
    rows += [(r, f, k + 1000, y, x, 50) for r, f, k, y, x, _ in rows[:40]]
    found = linking.link_candidates(spark.createDataFrame(rows, SCHEMA), 10.0, 4)
    want = {(p[1], p[2], q[1], q[2], q[1] - p[1]): d for p in rows for q in rows if 1 <= q[1] - p[1] <= 4 and (d := math.sqrt((p[3] - q[3]) * (p[3] - q[3]) + (p[4] - q[4]) * (p[4] - q[4]))) <= 10.0 * (q[1] - p[1])}
    got = found.collect()
    assert {(r["frame"], r["label"], r["frame2"], r["label2"], r["gap"]): r["dist"] for r in got} == want and len(got) == len(want)
    assert not any("gap" in line for line in plan(found).splitlines() if "hashpartitioning" in line)


def test_parts_hold_all_that_may_link(spark, monkeypatch):
    """parts come from boxes, without the candidates; both ends of every candidate are in one."""
    rng = np.random.default_rng(5)
    rows = [("a", int(f), k, float(y), float(x), 50) for k, (f, y, x) in enumerate(zip(rng.integers(0, 30, 300), rng.integers(-30, 30, 300) * 10, rng.integers(-30, 30, 300) * 10))]
    det = spark.createDataFrame(rows + [("a", 3, 900, None, 1.0, 50), ("a", 4, 901, float("nan"), 1.0, 50)], SCHEMA)
    part = {(r["frame"], r["label"]): r["part"] for r in linking.may_meet(det, 10.0, 4).collect()}
    pairs = linking.link_candidates(det, 10.0, 4).collect()
    assert len(part) == 302 and len(pairs) > 20 and len(set(part.values())) > 20
    assert all(part[r["frame"], r["label"]] == part[r["frame2"], r["label2"]] for r in pairs)
    monkeypatch.delattr(linking, "link_candidates")
    assert linking.track_assign(det, 10.0, 4).count() == 302


def test_stream_of_packed_frames(spark):
    """a frame's detections reach the tracker as a few rows; the tracks are those of single rows, also of places that are null."""
    rng = np.random.default_rng(7)
    rows = [("a", f, k, float(y), float(x), 50) for f in range(9) for k, (y, x) in enumerate(rng.integers(0, 60, (30, 2)))] + [("b", 3, 0, None, 1.0, 50), ("b", 4, 1, 2.0, 1.0, 50)]
    timed = sessions.event_time(spark.createDataFrame(rows, SCHEMA))
    found = sessions.packed(timed, 7)
    assert found.count() == 9 * 5 + 2 and max(len(r["labels"]) for r in found.collect()) == 7
    key = lambda df: sorted((r["recording_id"], r["frame"], r["label"], r["track_id"], r["cy"] if r["cy"] == r["cy"] else None) for r in df.collect())
    with sessions.rocksdb(spark):
        assert key(sessions._replay(found, sessions.tracker, slices=1)) == key(sessions._replay(timed, sessions.tracker, slices=1))
