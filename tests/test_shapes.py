"""Holes, outer boundaries, hulls and descriptors against brute force over pixels."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import edges, masks, objects

SCHEMA = "recording_id string, frame int, label int, row_ int, col_ int"


def scattered(seed, n, size=9, share=0.6):
    rng = np.random.default_rng(seed)
    grid = rng.random((n, size, size)) < share
    return [("a", int(f), 1 + int(f) % 2, int(r) + 3, int(c) - 2) for f, r, c in np.argwhere(grid)], grid


def outside(grid):
    """Background that hangs together with the surroundings by rows and columns, on a grid padded by 1."""
    padded = np.pad(grid, 1)
    seen, todo = np.zeros_like(padded), [(0, 0)]
    seen[0, 0] = True
    while todo:
        r, c = todo.pop()
        for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= q[0] < padded.shape[0] and 0 <= q[1] < padded.shape[1] and not padded[q] and not seen[q]:
                seen[q] = True
                todo.append(q)
    return padded, seen


@pytest.mark.parametrize("share", [0.35, 0.6, 0.8])
def test_outer_boundary_and_holes(spark, share):
    rows, grids = scattered(1, 40, share=share)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["frame"], r["row_"] - 3, r["col_"] + 2) for r in masks.boundary_pixels(df).collect()}
    enclosed = {(r["frame"], r["row_"] - 3, c + 2) for r in masks.holes(df).collect() for c in range(r["c0"], r["c1"] + 1)}
    edge = {(r["frame"], r["row_"] - 3, r["col_"] + 2) for r in masks.edge_pixels(df).collect()}
    want, inner, every = set(), set(), set()
    for f, grid in enumerate(grids):
        padded, out = outside(grid)
        for r, c in itertools.product(range(1, 10), range(1, 10)):
            near = ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1))
            if padded[r, c]:
                want |= {(f, r - 1, c - 1)} if any(out[q] for q in near) else set()
                every |= {(f, r - 1, c - 1)} if any(not padded[q] for q in near) else set()
            elif not out[r, c]:
                inner.add((f, r - 1, c - 1))
    assert got == want and enclosed == inner and edge == every and inner


def test_ring_and_disc_have_one_boundary(spark):
    disc = [(r, c) for r in range(30) for c in range(30)]
    ring = [(r, c) for r, c in disc if not (5 <= r < 25 and 5 <= c < 25)]
    slit = [(r, c) for r, c in ring if not (r == 15 and c >= 25)]
    df = spark.createDataFrame([("a", f, 1, r, c) for f, px in enumerate((disc, ring, slit)) for r, c in px], SCHEMA)
    radii = {f: {r["sector"]: (r["radius"], r["n"]) for r in edges.polar_sectors(df.where(F.col("frame") == f), 8).collect()} for f in range(3)}
    assert radii[0] == radii[1] != radii[2]
    assert masks.holes(df).where("frame = 1").agg(F.sum(F.expr("c1 - c0 + 1"))).first()[0] == 400 and masks.holes(df).where("frame <> 1").count() == 0
    # An island in a hole has no outer boundary of its own.
    island = df.where("frame = 1").unionByName(spark.createDataFrame([("a", 1, 1, 15, 15)], SCHEMA))
    assert masks.boundary_pixels(island).count() == masks.boundary_pixels(df.where("frame = 0")).count() == 116
    assert masks.boundary_pixels(df.limit(0)).count() == masks.holes(df.limit(0)).count() == masks.convex_areas(df.limit(0)).count() == 0


def brute_convex(pixels):
    """Lattice points on the inner side of every line through two edge midpoints that has all others on one side."""
    points = sorted({(2 * r + a, 2 * c + b) for r, c in pixels for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))})
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    sides = [(p, q) for p, q in itertools.permutations(points, 2) if all(cross(p, q, x) >= 0 for x in points)]
    rows, cols = [r for r, _ in pixels], [c for _, c in pixels]
    return sum(all(cross(p, q, (2 * r, 2 * c)) >= 0 for p, q in sides) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1))


@pytest.mark.parametrize("band", [1, 3, 256])
def test_convex_areas(spark, band):
    rng = np.random.default_rng(5)
    shapes = [sorted({(int(r), int(c)) for r, c in rng.integers(-4, 5, (n, 2))}) for n in (1, 2, 3, 4, 6, 9, 14, 20)] + [[(0, 0), (0, 5)], [(0, 0), (5, 0)], [(0, 0), (3, 3)]]
    df = spark.createDataFrame([("a", f, 1, r, c) for f, px in enumerate(shapes) for r, c in px], SCHEMA)
    assert {r["frame"]: r["convex"] for r in masks.convex_areas(df, band).collect()} == {f: brute_convex(px) for f, px in enumerate(shapes)}
    got = {r["frame"]: r["solidity"] for r in objects.solidity(df).collect()}
    assert got == {f: len(px) / brute_convex(px) for f, px in enumerate(shapes)}
    assert {r["frame"]: r["solidity"] for r in masks.shape_descriptors(df).collect()} == got
