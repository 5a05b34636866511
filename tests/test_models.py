"""Fitted models and shape vectors: numpy versions, fixed-point conditions and separable cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import masks, pixels, shapes

PX = "recording_id int, frame int, row_ int, col_ int, intensity double"


def frames(spark, grids):
    return spark.createDataFrame([(0, f, r, c, float(v)) for f, g in enumerate(grids) for (r, c), v in np.ndenumerate(g)], PX)


def deviation(grid, k=1):
    """Standard deviation in the box around every pixel: rows first averaged down, then across, each cut at the ends."""
    def boxed(x):
        down = np.array([[x[max(0, r - k):r + k + 1, c].mean() for c in range(x.shape[1])] for r in range(x.shape[0])])
        return np.array([[down[r, max(0, c - k):c + k + 1].mean() for c in range(x.shape[1])] for r in range(x.shape[0])])
    return np.sqrt(np.maximum(0, np.round(boxed(grid * grid) - boxed(grid) ** 2, 9)))


def textured(seed):
    rng = np.random.default_rng(seed)
    grid = np.full((12, 12), 100.0)
    grid[2:8, 3:9] += rng.choice([-60, 60], (6, 6))
    grid[10, 10] += 40
    return grid


def test_texture_mask_against_brute_force(spark):
    grids = [textured(s) for s in range(4)]
    got = {}
    for r in pixels.texture_mask(frames(spark, grids)).collect():
        got.setdefault(r["frame"], set()).add((r["row_"], r["col_"]))
    for f, grid in enumerate(grids):
        s = np.floor(deviation(grid)).astype(int)
        best = max((round(n0 * n1 * (a / n0 - b / n1) ** 2 / s.size**2, 6) if n1 else 0.0, -t) for t in np.unique(s) for n0, n1 in [((s <= t).sum(), (s > t).sum())] for a, b in [(s[s <= t].sum(), s[s > t].sum())])
        rough, parts = {(int(r), int(c)) for r, c in np.argwhere(s > -best[1])}, []
        while rough:
            todo, part = [min(rough)], set()
            while todo:
                p = todo.pop()
                if p in rough:
                    rough.discard(p)
                    part.add(p)
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            parts.append(part)
        assert got[f] == max((p for p in parts if len(p) >= 4), key=len)


def test_kmeans_is_at_a_fixed_point(spark):
    rng = np.random.default_rng(1)
    grids = [np.where(np.arange(64).reshape(8, 8) % 8 < 4, 30, 200) + rng.integers(-5, 6, (8, 8)) for _ in range(3)]
    rows = pixels.kmeans_pixels(frames(spark, grids)).join(frames(spark, grids), pixels.PIXEL).collect()
    x = np.array([(r["intensity"], 50 * r["row_"] / 8, 50 * r["col_"] / 8) for r in rows])
    at = np.array([r["cluster"] for r in rows])
    centres = np.array([x[at == k].mean(axis=0) for k in range(3)])
    assert set(at) == {0, 1, 2} and (((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == at).mean() > 0.98
    assert len({tuple(sorted(set(at[x[:, 0] < 100]))), tuple(sorted(set(at[x[:, 0] > 100])))}) == 2 and not set(at[x[:, 0] < 100]) & set(at[x[:, 0] > 100])


def test_mixture_and_forest_on_a_separable_case(spark):
    grids = [textured(s) for s in range(6)]
    px = frames(spark, grids)
    inner = lambda r: 3 <= r["row_"] < 7 and 4 <= r["col_"] < 8
    far = lambda r: r["row_"] in (0, 11) and r["col_"] < 9 or r["col_"] == 0
    gm = pixels.gmm_pixels(px).collect()
    assert all(0 <= r["probability"] <= 1 for r in gm) and len(gm) == 6 * 144
    assert min(r["probability"] for r in gm if inner(r)) > 0.9 and max(r["probability"] for r in gm if far(r)) < 0.1
    truth = ((F.col("row_") >= 2) & (F.col("row_") < 8) & (F.col("col_") >= 3) & (F.col("col_") < 9)).cast("double")
    labelled = px.where("frame % 2 = 0").select(*pixels.PIXEL, truth.alias("label"))
    rf = {(r["frame"], r["row_"], r["col_"]): r["probability"] for r in pixels.rf_pixels(px, labelled).collect()}
    assert len(rf) == 6 * 144 and all(0 <= p <= 1 for p in rf.values())
    held = [(p >= 0.5) == (2 <= r < 8 and 3 <= c < 9) for (f, r, c), p in rf.items() if f % 2]
    assert np.mean(held) > 0.9
    both = pixels.ensemble_probability(px, labelled).collect()
    gm = {(r["frame"], r["row_"], r["col_"]): r["probability"] for r in gm}
    spread = {f: deviation(g) for f, g in enumerate(grids)}
    rest = []
    for r in both:
        key = r["frame"], r["row_"], r["col_"]
        rest.append((3 * r["probability"] - rf[key] - spread[key[0]][key[1:]] / spread[key[0]].max(), gm[key]))
        assert -0.3 <= rest[-1][0] <= 1.3 and r["foreground"] == (r["probability"] >= 0.5)
    assert np.mean([abs(a - b) for a, b in rest]) < 0.1  # two fits of mixture and forest differ in a few pixels


def brute_vector(points, n=50):
    """Contour vector of pixels without holes, sector by sector."""
    y, x = np.array(points, float).T
    cy, cx = y.mean(), x.mean()
    turn = 0.5 * math.atan2(2 * ((y - cy) * (x - cx)).mean(), x.var() - y.var())
    inside = set(points)
    edge = [(r - cy, c - cx) for r, c in points if any(q not in inside for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)))]
    if len(edge) < 10:
        return None
    by = {}
    for a, b in edge:
        angle = math.atan2(a * math.cos(turn) - b * math.sin(turn), b * math.cos(turn) + a * math.sin(turn))
        by.setdefault(int((angle + math.pi + math.pi / n + 1e-9) // (2 * math.pi / n)) % n, []).append(math.hypot(a, b))
    known = sorted(by)
    v = np.interp(np.arange(n), known, [np.median(by[k]) for k in known])
    return v / v.mean()


def test_shape_vectors_against_brute_force(spark):
    shapes_ = [[(r, c) for r in range(-12, 13) for c in range(-12, 13) if (r / a) ** 2 + (c / b) ** 2 <= 1] for a, b in ((9, 7.3), (5, 11), (11, 4))]
    shapes_ += [[(r, c) for r in range(9) for c in range(14) if not (r > 3 and c > 6)], [(0, 0), (0, 1)], [(r, c + r) for r in range(10) for c in range(4)]]
    df = spark.createDataFrame([("a", f, 1, r, c) for f, px in enumerate(shapes_) for r, c in px], "recording_id string, frame int, label int, row_ int, col_ int")
    got = {r["frame"]: r["v"] for r in shapes.shape_vectors(df).collect()}
    want = {f: brute_vector(px) for f, px in enumerate(shapes_)}
    assert set(got) == {f for f, v in want.items() if v is not None} and all(np.allclose(got[f], want[f], atol=1e-9) for f in got)
    ring = df.where("frame = 0 and not (row_ between -3 and 3 and col_ between -3 and 3)")
    assert np.allclose(shapes.shape_vectors(ring).first()["v"], got[0], atol=0.02) and masks.boundary_pixels(ring).count() == masks.boundary_pixels(df.where("frame = 0")).count()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = 1 + rng.normal(size=(60, 8)) * [3, 2, 1.5, 1, 0.5, 0.2, 0.1, 0.05] @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x[:20] += 12 * np.eye(8)[0]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")


def test_components_equal_numpy(vectors):
    x, df = vectors
    mean = x.mean(axis=0)
    _, size, turned = np.linalg.svd(x - mean)
    turned *= np.where(turned[np.arange(8), np.abs(turned).argmax(axis=1)] < 0, -1, 1)[:, None]
    rows = sorted(shapes.shape_components(df).collect())
    assert np.allclose([r["direction"] for r in rows], turned, atol=1e-6) and np.allclose([r["explained"] for r in rows], size**2 / (size**2).sum()) and np.allclose(rows[0]["mean"], mean)
    scores = {r["vec_id"]: r["scores"] for r in shapes.shape_pca(df).collect()}
    assert np.allclose([scores[i] for i in range(60)], (x - mean) @ turned.T, atol=1e-6)
    for r in shapes.eigenshapes(df).collect():
        step = 0.3 * turned[r["component"], r["point"]]
        assert r["component"] < 4 and (r["low"], r["mean"], r["high"]) == pytest.approx((mean[r["point"]] - step, mean[r["point"]], mean[r["point"]] + step), abs=1e-6)
    assert shapes.shape_pca(df.limit(0)).count() == shapes.shape_components(df.limit(0)).count() == 0


def test_modes_are_at_a_fixed_point(vectors):
    x, df = vectors
    at = {r["vec_id"]: r["mode"] for r in shapes.shape_modes(df, 2).collect()}
    found = np.array([at[i] for i in range(60)])
    centres = np.array([x[found == k].mean(axis=0) for k in (0, 1)])
    assert (((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == found).all() and len(set(found[:20])) == 1 and np.mean(found[20:] != found[0]) > 0.9
    assert shapes.shape_modes(df.limit(4)).count() == 0 and set(r["mode"] for r in shapes.shape_modes(df.limit(5), 9).collect()) == {0, 1}
