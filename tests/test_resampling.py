"""Mergeable statistics, bootstrap intervals and exact quantiles against whole groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.quantiles import exact_quantiles
from strandline.operators import resampling as rs
from strandline.plans import catalog

SCHEMA = "metric string, grp string, value double"


def table(spark, **groups):
    return spark.createDataFrame([("m", g, float(v)) for g, vs in groups.items() for v in vs], SCHEMA).repartition(3)


def resamples(spark, values, n_boot, size, seed="42", metric="m", grp="A"):
    """Values of every resample, in one place: the tree of buckets walked node by node over all draws."""
    x, t = np.unique(np.array(values, float), return_counts=True)
    k = max(1, math.ceil(len(x) / size))
    bucket = {r["v"]: r["b"] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select("v", F.pmod(F.xxhash64("v"), F.lit(k)).alias("b")).collect()}
    rows = {}
    for v, c in zip(x, t):
        rows.setdefault(bucket[v], []).append((v, int(c)))
    depth = math.ceil(math.log2(k)) if k > 1 else 0
    under = lambda level, node: sum(c for b, r in rows.items() if b >> level == node for _, c in r)

    def split(level, node, draws):
        """{bucket: draws of each resample} below a node."""
        if not level:
            return {node: draws}
        whole, left = under(level, node), under(level - 1, 2 * node)
        first = rs._generator(seed, metric, grp, level, node).binomial(draws, left / whole)
        out = split(level - 1, 2 * node, first) if left else {}
        return out | (split(level - 1, 2 * node + 1, draws - first) if left < whole else {})

    out = [[] for _ in range(n_boot)]
    for b, draws in split(depth, 0, np.full(n_boot, len(values), np.int64)).items():
        each, times = np.array(rows[b], float).T
        rng = rs._generator(seed, metric, grp, "rows", b)
        for k, d in enumerate(draws):
            out[k] += np.repeat(each, rs.draw_counts(int(d), times.astype(np.int64), np.cumsum(times).astype(np.int64), rng)).tolist()
    assert all(len(o) == len(values) for o in out)
    return [np.sort(o) for o in out]


@pytest.mark.parametrize("size", [1, 2, 5, 16_384])
def test_bootstrap_against_whole_resamples(spark, size):
    v = [1, 2, 2, 5, 9, 11, 12, 12, 12, 40, 41.5, -3]
    drawn = resamples(spark, v, 300, size)
    df = table(spark, A=v, B=[7], C=[3, 3, 3])
    for stat, fn in ((rs.Mean(), np.mean), (rs.Extent(), np.ptp), (np.median, np.median)):
        m = np.array([fn(x) for x in drawn])
        a, b, c = rs.bootstrap_statistic(df, stat, 300, bucket=size).orderBy("grp").collect()
        assert np.allclose([a["statistic"], a["ci_low"], a["ci_high"], a["se"]], [fn(v), *np.percentile(m, [2.5, 97.5]), m.std()])
        assert tuple(b[3:]) == (b["statistic"], b["statistic"], 0) and b["statistic"] == fn([7]) and tuple(c[2:]) == (fn([3]), fn([3]), fn([3]), 0)


def test_bootstrap_has_the_right_spread(spark):
    v = np.random.default_rng(3).normal(10, 2, 4000).round(3)
    few, many = (rs.bootstrap_ci(table(spark, A=v), bucket=b).first() for b in (100, 16_384))
    for got in (few, many):
        assert got["mean"] == pytest.approx(v.mean()) and got["se"] == pytest.approx(v.std() / math.sqrt(len(v)), rel=0.1)
        assert got["ci_high"] - got["ci_low"] == pytest.approx(3.92 * v.std() / math.sqrt(len(v)), rel=0.15)
    again = rs.bootstrap_ci(table(spark, A=v[::-1]).repartition(7), bucket=100).first()
    assert tuple(again)[2:] == pytest.approx(tuple(few)[2:], rel=1e-12)
    assert catalog.QUERIES["bootstrap_ci"] and rs.bootstrap_ci.__defaults__[0] == 1000


def test_draws_of_a_hot_value(spark):
    """Half of ten million rows are one value: work follows distinct values, not rows."""
    t = np.array([5_000_000, *[50] * 100_000])
    counts = rs.draw_counts(10_000_000, t, np.cumsum(t), np.random.default_rng(1))
    assert counts.sum() == 10_000_000 and abs(counts[0] / 5_000_000 - 1) < 0.01
    path = [(2, 0, 100, 60), (1, 0, 60, 20)]
    assert (rs.split_draws(50, 400, 0, path, "s") + rs.split_draws(50, 400, 1, path, "s") <= 50).all() and rs.split_draws(50, 400, 0, path, "s").mean() == pytest.approx(10, rel=0.1)


@pytest.mark.parametrize("flush", [1, 10_000])
def test_group_statistics_merge(spark, flush):
    rng = np.random.default_rng(9)
    groups = {f"g{k}": rng.integers(0, 30, 1 + 40 * k) for k in range(8)}
    df = table(spark, **groups).unionByName(spark.createDataFrame([("m", "none", None), ("m", None, 4.0)], SCHEMA))
    for stat, fn in ((rs.Mean(), np.mean), (rs.Extent(), np.ptp), (np.std, np.std)):
        got = {r["grp"]: r["statistic"] for r in rs.group_statistic(df, stat, flush).collect()}
        assert got == {g: pytest.approx(fn(v)) for g, v in groups.items()} | {None: pytest.approx(fn([4.0]))}
    assert rs.group_statistic(df.limit(0), rs.Mean()).count() == rs.bootstrap_ci(df.limit(0)).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "ties": [1.0] * 50 + [2.0] * 50, "many": rng.normal(size=3000), "hot": [0.0] * 900 + rng.normal(size=100).tolist()}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan")), ("bare", None)]
    shares = {"low": 0.0, "p1": 0.01, "q1": 0.25, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()
    assert {r["g"]: tuple(r[n] for n in shares) for r in got} == {g: pytest.approx(tuple(np.quantile(v, list(shares.values())))) for g, v in groups.items()} | {"bare": (None,) * 6}
