"""Findings of the third review on size: what is sorted, shuffled and held. They were not run on the code before."""

import math
import random

from strandline.operators import edges, linking, masks, shapes

PX = [("a", f, 1, r, c) for f in range(3) for r in range(12) for c in range(9 + f) if not (f and 3 < r < 6 and 3 < c < 6)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pixels(spark):
    return spark.createDataFrame(PX, "recording_id string, frame int, label int, row_ int, col_ int")


def test_pixels_are_not_sorted(spark):
    px = pixels(spark)
    for df in (masks.boundary_pixels(px), masks.edge_pixels(px), masks.chain_length(px)):
        assert "Window" not in plan(df)
    assert "SortMergeJoin" not in plan(masks.largest_component(px))


def test_words_across_their_bounds(spark):
    rows = [("a", 0, 1, r, c) for r in (-2, -1, 0) for c in range(-70, 131) if (r, c) not in ((-1, 63), (-1, 64), (-1, -64))]
    px = spark.createDataFrame(rows, "recording_id string, frame int, label int, row_ int, col_ int")
    assert {(r["row_"], r["c0"], r["c1"]) for r in masks.holes(px).collect()} == {(-1, 63, 64), (-1, -64, -64)}
    assert masks.boundary_pixels(px).where("row_ = -1").count() == 2 and masks.edge_pixels(px).where("row_ = -1").count() == 6


def test_kymograph_is_smoothed_as_arrays(spark):
    px = pixels(spark)
    found = edges.edge_kymograph(px, 8)
    assert "hashpartitioning(recording_id#" in plan(found) and not any("sector" in line for line in plan(found).splitlines() if "hashpartitioning" in line)
    assert found.count() == 2 * 8 and shapes.shape_vectors(px).count() == 3


def test_nearest_of_crowded_places(spark):
    rng = random.Random(5)
    at = [(f, float(rng.randrange(12)), float(rng.randrange(12))) for f in range(6) for _ in range(60)]
    rows = [("a", f, k, y, x, 5 + k % 3) for f in range(6) for k, (g, y, x) in enumerate(at) if g == f]
    det = spark.createDataFrame(rows, "recording_id string, frame int, label int, cy double, cx double, area_px int")
    d = lambda p, q: math.sqrt((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2)
    best = lambda p, f: min(((d(p, q), q[2]) for q in rows if q[1] == f and d(p, q) <= 3.0), default=None)
    want = set()
    for p in rows:
        out = best(p, p[1] + 1)
        q = next((q for q in rows if out and q[1] == p[1] + 1 and q[2] == out[1]), None)
        if q and best(q, p[1])[1] == p[2]:
            want.add((p[1], p[2], q[2]))
    found = linking.link_mutual_nearest(det, 3.0)
    assert {(r["frame"], r["label"], r["label2"]) for r in found.collect()} == want
    assert "Window" not in plan(found)
    now, walk = max((p for p in rows if p[1] == 0), key=lambda p: (p[5], -p[2])), []
    for f in range(6):
        if f:
            out = best(now, f)
            if not out:
                continue
            now = next(q for q in rows if q[1] == f and q[2] == out[1])
        walk.append((f, now[2]))
    assert sorted((r["frame"], r["label"]) for r in linking.anchor_single(det, 3.0).collect()) == walk
