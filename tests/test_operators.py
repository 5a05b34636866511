"""Known answers and edge cases of the tracking operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.graph import connected_components
from strandline.functions.primitives import average_rank, convolve, fill_linear, gaussian_weights
from strandline.operators import linking, masks, objects, quality, resampling, stats, tracks


def square(spark, frames, r0=20, c0=10, size=10, step=2, skip=()):
    rows = [("a", f, 1, r, c) for f in range(frames) if f not in skip for r in range(r0, r0 + size) for c in range(c0 + step * f, c0 + step * f + size)]
    return spark.createDataFrame(rows, "recording_id string, frame int, label int, row_ int, col_ int")


def points(spark, series):
    rows = [("a", 1, i, None if p is None else float(p[0]), None if p is None else float(p[1])) for i, p in enumerate(series)]
    return spark.createDataFrame(rows, "recording_id string, track_id long, frame int, cy double, cx double")


def test_moving_square(spark):
    c = masks.centroid_series(square(spark, 10)).withColumn("track_id", F.lit(1))
    row = tracks.analyze_recording(c, 1.0).first()
    assert (round(row["mean_speed"], 9), round(row["total_distance"], 9), round(row["net_displacement"], 9), round(row["persistence"], 9)) == (2.0, 18.0, 18.0, 1.0)


def test_static_square(spark):
    px = square(spark, 3, 30, 30, 40, 0)
    row = masks.shape_descriptors(px, 1.0).first()
    assert row["area_um2"] == 1600 and row["perimeter_um"] == 156 and row["circularity"] < 1 and row["aspect_ratio"] == 1 and row["eccentricity"] < 1e-6
    assert {r["solidity"] for r in objects.solidity(px).collect()} == {1.0}
    assert {(r["iou"], r["filled"]) for r in masks.consecutive_iou(px).collect()} == {(1.0, True)}


def test_lost_frame_is_suspect_and_reappearing_is_not(spark):
    found = {r["frame"]: (r["suspect"], r["reason"]) for r in quality.suspect_frames(square(spark, 10, 0, 0, 50, 0, skip=(5,))).collect()}
    assert found[5] == (True, "lost") and found[6] == (False, None)


def test_gaps_give_no_speed_but_bridge_net_displacement(spark):
    p = points(spark, [(0, 0), (0, 3), None, (0, 9)])
    assert [r["speed"] for r in tracks.instantaneous_speed(p, 1.0).orderBy("frame").collect()] == [3.0, None, None]
    assert tracks.net_displacement(p).first()["net_displacement"] == 9.0


def test_one_point_and_no_motion(spark):
    one = points(spark, [(1, 1)])
    assert tracks.net_displacement(one).first()["net_displacement"] is None
    assert tracks.msd(one).count() == 0 and tracks.direction_autocorrelation(one).count() == 0
    still = tracks.analyze_recording(points(spark, [(1, 1)] * 4)).first()
    assert still["total_distance"] == 0 and still["persistence"] is None


def test_msd_of_a_line_and_fit(spark):
    p = points(spark, [(i, 0) for i in range(12)])
    curve = {r["lag"]: (r["msd"], r["sem"]) for r in tracks.msd(p).collect()}
    assert curve == {k: (float(k * k), 0.0) for k in range(1, 6)}
    fit = tracks.msd_diffusion_fit(tracks.msd(p), 1.0).first()
    assert abs(fit["alpha"] - 2) < 1e-9 and abs(fit["d"] - 0.25) < 1e-9
    few = spark.createDataFrame([("a", 1, 1, 2.0)], "recording_id string, track_id long, lag int, msd double")
    assert tuple(tracks.msd_diffusion_fit(few).first())[2:] == (0.0, 1.0, 0.0)


def test_smoothing_keeps_length_and_constant(spark):
    out = tracks.smooth_trajectory(points(spark, [(2, 2)] * 10 + [None])).orderBy("frame").collect()
    assert len(out) == 11 and out[-1]["cy"] is None and all(abs(r["cy"] - 2) < 1e-9 for r in out[:10])


def test_convolve_matches_numpy(spark):
    x = np.arange(9.0) ** 2
    w = gaussian_weights(1.0)
    got = convolve(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double"), ["k"], "i", ["v"], w).orderBy("i").collect()
    want = np.convolve(np.pad(x, 4, mode="symmetric"), w, mode="valid")
    assert np.allclose([r["v"] for r in got], want)


def test_fill_linear(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "k int, t int, v double")
    assert [r["o"] for r in fill_linear(df, ["k"], "t", "v", "o").orderBy("t").collect()] == [2, 2, 4, 6, 8, 8]


def test_components_of_pixels(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((12, 12)) < 0.45
    df = spark.createDataFrame([("a", 0, 1, int(r), int(c)) for r, c in zip(*np.nonzero(grid))], "recording_id string, frame int, label int, row_ int, col_ int")
    for n in (4, 8):
        got = {(r["row_"], r["col_"]): r["label"] for r in masks.connected_components(df, n).collect()}
        label, want = {}, 0
        for p in sorted(got):
            if p not in label:
                want += 1
                stack = [p]
                while stack:
                    q = stack.pop()
                    if q in label or q not in got:
                        continue
                    label[q] = want
                    stack += [(q[0] + a, q[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (n == 8 or not a * b)]
        assert got == label


@pytest.mark.parametrize("seed", range(3))
def test_graph_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(1, 1), (None, 2)] + [(0, 100 + k) for k in range(50 * (seed == 2))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = sorted(int(v) for v in rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        got = cost[np.arange(n), linking.assign(cost)].sum()
        assert abs(got - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))) < 1e-9
    assert linking.match(np.zeros((0, 3)), np.zeros((0, 3), bool)) == []
    # As many matches as possible come before the least distance.
    near = np.array([[1.0, 2.0], [1.5, 50.0]])
    assert sorted(linking.match(near, near < 10)) == [(0, 1), (1, 0)]


def test_tracker_gap_and_spawn(spark):
    det = [("a", f, 1, 0.0, float(f), 100) for f in (0, 1, 12, 24)] + [("a", 1, 2, 500.0, 500.0, 100)]
    df = spark.createDataFrame(det, "recording_id string, frame int, label int, cy double, cx double, area_px long")
    ids = {(r["frame"], r["label"]): r["track_id"] for r in linking.track_assign(df).collect()}
    assert ids[0, 1] == ids[1, 1] == ids[12, 1] != ids[24, 1] and ids[1, 2] != ids[1, 1]
    assert len(set(map(tuple, linking.track_assign(df).select("track_id", "frame").collect()))) == len(det)
    sessions = linking.gap_sessions(df.where("label = 1"), ["recording_id"]).orderBy("session").collect()
    assert [(r["first_frame"], r["last_frame"], r["n"]) for r in sessions] == [(0, 12, 3), (24, 24, 1)]


def groups(spark, **kw):
    return spark.createDataFrame([("m", g, float(v)) for g, vs in kw.items() for v in vs], "metric string, grp string, value double")


def test_two_groups(spark):
    rows = {r["test"]: r for r in stats.group_comparison(groups(spark, A=[1, 2, 3, 4], B=[10, 11, 12, 13])).collect()}
    assert rows["welch_t"]["p"] < 0.001 and rows["welch_t"]["marker"] == "***" and set(rows) == {"welch_t", "mann_whitney_u"}


def test_three_groups(spark):
    g = groups(spark, A=[1, 2, 3], B=[4, 5, 6], C=[7, 8, 9])
    rows = {r["test"]: r for r in stats.group_comparison(g).collect()}
    assert set(rows) == {"anova", "kruskal_wallis"} and abs(rows["anova"]["statistic"] - 27) < 1e-9 and abs(rows["kruskal_wallis"]["statistic"] - 7.2) < 1e-9
    assert stats.pairwise_bonferroni(g).count() == 3
    assert stats.cohens_d(groups(spark, A=[1, 1], B=[1, 1])).first()["d"] == 0


@pytest.mark.parametrize("args, p", [(("t", 2.228, 10, 0), 0.05), (("t", 2.0, 60, 0), 0.05), (("f", 4.2565, 2, 9), 0.05), (("chi2", 5.991, 2, 0), 0.05), (("chi2", 18.307, 10, 0), 0.05), (("z", 1.959964, 0, 0), 0.05)])
def test_p_values_against_tables(args, p):
    assert abs(stats.p_value(*args) - p) < 4e-4


def test_ranks_bootstrap_normality(spark):
    r = {(x["value"], x["rank"], x["ties"]) for x in average_rank(groups(spark, A=[1, 2, 2, 5]), ["metric"], "value").collect()}
    assert r == {(1.0, 1.0, 1), (2.0, 2.5, 2), (5.0, 4.0, 1)}
    b = resampling.bootstrap_ci(groups(spark, A=[1, 2, 3, 4, 5], B=[7])).orderBy("grp").collect()
    assert b[0]["ci_low"] < b[0]["mean"] < b[0]["ci_high"] and (b[1]["ci_low"], b[1]["ci_high"], b[1]["se"]) == (7, 7, 0)
    rng = np.random.default_rng(1)
    n = {x["grp"]: x["normal"] for x in stats.normality_check(groups(spark, N=rng.normal(size=200), E=rng.exponential(size=200), F=[1, 2])).collect()}
    assert n == {"N": True, "E": False, "F": True}


def test_markers(spark):
    df = spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.1,)], "p double")
    assert [r[0] for r in df.select(stats.significance_marker(F.col("p"))).collect()] == ["***", "**", "*", "ns"]


def test_edges_of_a_disc(spark):
    from strandline.operators import edges
    px = spark.createDataFrame([("a", f, 1, r, c) for f in (0, 1) for r in range(-12, 13) for c in range(-12, 13) if r * r + c * c <= (8 + 2 * f) ** 2], "recording_id string, frame int, label int, row_ int, col_ int")
    v = edges.edge_velocity_pair(px, 24, 1.0, 1.0).agg(F.avg("velocity"), F.count("*")).first()
    assert abs(v[0] - 2) < 0.3 and v[1] == 24
    s = edges.edge_summary(edges.edge_velocity_pair(px, 24, 1.0, 1.0)).first()
    assert s["mean_retraction_velocity"] == 0 and s["protrusion_fraction"] == 1


def test_entropy_bounds(spark):
    from strandline.operators import shapes
    m = spark.createDataFrame([(i, i % 4) for i in range(40)], "vec_id long, mode_id int")
    row = shapes.shape_heterogeneity(m, 4).first()
    assert abs(row["entropy"] - 2) < 1e-9 and abs(row["normalised"] - 1) < 1e-9
    assert math.isclose(sum(r["fraction"] for r in shapes.mode_fractions(m, 6).collect()), 1)


def test_failing_user_function_keeps_object(spark):
    px = square(spark, 2)

    def fn(crop):
        raise RuntimeError
    assert objects.per_object_apply(px, fn).count() == px.count()


@pytest.mark.parametrize("m,n", [(1, 1), (2, 3), (3, 3), (4, 5), (5, 5)])
def test_exact_u_against_all_orders(m, n):
    seen = [sum(r > s for r in first for s in range(m + n) if s not in first) for first in itertools.combinations(range(m + n), m)]
    assert stats.u_counts(m, n) == [seen.count(u) for u in range(m * n + 1)]
    for u in range(m * n + 1):
        low = sum(s <= min(u, m * n - u) for s in seen) / len(seen)
        assert stats.p_value("u", u, m, n) == pytest.approx(min(1, 2 * low)) == stats.p_value("u", u, n, m)


@pytest.mark.parametrize("m,n,u,p", [(4, 4, 0, 0.0286), (5, 5, 2, 0.0317), (8, 8, 13, 0.0499), (3, 8, 2, 0.0485), (5, 8, 6, 0.0451)])
def test_exact_u_against_tables(m, n, u, p):
    """Published critical values of the two-sided test at 5 %: u is within the level, u + 1 is not."""
    assert stats.p_value("u", u, m, n) == pytest.approx(p, abs=6e-4) and stats.p_value("u", u, m, n) <= 0.05 < stats.p_value("u", u + 1, m, n) or (m, n, u) == (4, 4, 0)


def test_small_groups_are_tested_exactly(spark):
    got = {r["test"]: r for r in stats.group_comparison(groups(spark, A=[1, 2, 3, 4], B=[10, 11, 12, 13])).collect()}
    assert got["mann_whitney_u"]["kind"] == "u" and got["mann_whitney_u"]["statistic"] == 0 and got["mann_whitney_u"]["p"] == pytest.approx(2 / 70)
    tied = {r["test"]: r for r in stats.group_comparison(groups(spark, A=[1, 2, 3, 4], B=[4, 11, 12, 13])).collect()}
    assert tied["mann_whitney_u"]["kind"] == "z"


@pytest.mark.parametrize("values,w,p", [
    ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.7888, 0.0067),
    ([1, 2, 3], 1.0, 1.0), ([1, 1, 4], 0.75, 0.0), (list(range(1, 11)), 0.9702, 0.8924), (list(range(1, 51)), 0.9556, 0.0580)])
def test_shapiro_wilk_against_published_values(values, w, p):
    got = stats.shapiro_wilk(np.array(values, float))
    assert got[0] == pytest.approx(w, abs=2e-4) and got[1] == pytest.approx(p, abs=1.5e-3)


def test_shapiro_weights():
    for n in (3, 4, 5, 6, 11, 12, 50, 5000):
        a = stats.shapiro_weights(n)
        assert a @ a == pytest.approx(1) and np.allclose(a, -a[::-1]) and (np.diff(a) > 0).all()
    # Published weights for ten values.
    assert np.allclose(stats.shapiro_weights(10)[5:], [0.0399, 0.1224, 0.2141, 0.3291, 0.5739], atol=2e-3)
    rng = np.random.default_rng(0)
    ps = [stats.shapiro_wilk(rng.normal(size=n))[1] for n in (5, 8, 20, 100) for _ in range(400)]
    assert np.mean(np.array(ps) < 0.05) == pytest.approx(0.05, abs=0.02)


def test_comparison_result_holds_all_parts(spark):
    rows = stats.comparison_result(groups(spark, A=[1, 2, 3], B=[4, 5, 6], C=[7, 8, 9])).collect()
    parts = {(r["part"], r["item"]): r for r in rows}
    assert set(parts) == {("group", g) for g in "ABC"} | {("test", "anova"), ("test", "kruskal_wallis")} | {("pair", p) for p in ("A/B", "A/C", "B/C")}
    assert parts["group", "B"]["median"] == 5 and parts["pair", "A/C"]["d"] == pytest.approx(-6)
    two = {(r["part"], r["item"]) for r in stats.comparison_result(groups(spark, A=[1, 2, 3], B=[4, 5, 7])).collect()}
    assert two == {("group", "A"), ("group", "B"), ("test", "welch_t"), ("test", "mann_whitney_u")}


def test_group_comparison_reports_u(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 7.0, 8.0, 8.0, 11.0]
    got = {r["test"]: r for r in stats.group_comparison(groups(spark, A=a, B=b)).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    every = a + b
    n, ties = len(every), sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got["mann_whitney_u"]["statistic"] == u
    assert got["mann_whitney_u"]["p"] == pytest.approx(math.erfc((abs(u - len(a) * len(b) / 2) - 0.5) / sd / math.sqrt(2)), abs=1e-6)
    assert set(got) == {"mann_whitney_u", "welch_t"}


def test_nearest_detection_by_squares_as_by_all_pairs(spark):
    rng = np.random.default_rng(1)
    det = [("r", 0, k, float(y), float(x), 5) for k, (y, x) in enumerate(rng.uniform(-90, 90, (60, 2)))]
    want = [("r", k, 0, float(y), float(x)) for k, (y, x) in enumerate(rng.uniform(-90, 90, (40, 2)))]
    got = {r["track_id"]: (r["label"], r["dist"]) for r in linking.nearest_detection(spark.createDataFrame(want, "recording_id string, track_id int, frame int, cy double, cx double"), spark.createDataFrame(det, "recording_id string, frame int, label int, cy double, cx double, area_px int"), 17.0).collect()}
    brute = {}
    for _, t, _, y, x in want:
        d, label = min((math.hypot(y - q[3], x - q[4]), q[2]) for q in det)
        if d < 17:
            brute[t] = (label, pytest.approx(d))
    assert got == brute and 5 < len(got) < 40
