"""Group statistics over long tables (metric, grp, value). p-values are computed on the final few rows."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.primitives import running_sum
from strandline.functions.quantiles import exact_median

BY = ["metric", "grp"]


# --- tails of distributions, from their series and continued fractions ---------------------------------------------

def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * scale


@functools.lru_cache(64)
def u_counts(m: int, n: int) -> list[int]:
    """Number of orders of m and n values without ties for each U from 0 to m n: the coefficients of the Gaussian binomial, one factor after the other."""
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return counts


def u_tail(u: float, m: int, n: int) -> float:
    """Exact two-sided p of U."""
    m, n = min(m, n), max(m, n)
    counts = u_counts(m, n)
    return min(1.0, 2 * sum(counts[: math.floor(min(u, m * n - u)) + 1]) / math.comb(m + n, m))


#: U is tested exactly up to so many values in the smaller group and pairs of values, without ties.
SMALL, PAIRS = 8, 100_000


def p_value(test: str, statistic: float, df1: float, df2: float) -> float:
    """Two-sided p of t (df1), z and u (exact; group sizes df1 and df2), upper p of F (df1, df2) and chi-square (df1)."""
    if statistic is None or math.isnan(statistic):
        return float("nan")
    if test == "u":
        return u_tail(statistic, round(df1), round(df2))
    if test == "t":
        return beta_tail(df1 / 2, 0.5, df1 / (df1 + statistic * statistic))
    if test == "z":
        return math.erfc(abs(statistic) / math.sqrt(2))
    if test == "f":
        return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * statistic))
    return gamma_tail(df1 / 2, statistic / 2)


def with_p(tests: DataFrame) -> DataFrame:
    """tests(kind, statistic, df1, df2, ...) with p, one Arrow batch over the few result rows."""
    @F.pandas_udf("double")
    def p(kind: pd.Series, s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([p_value(k, x, u, v) for k, x, u, v in zip(kind, s, a, b)], dtype="float64")
    return tests.withColumn("p", p("kind", "statistic", "df1", "df2"))


def significance_marker(p):
    """***, ** , * or ns at .001, .01 and .05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


# --- descriptive and test statistics -------------------------------------------------------------------------------

def long_metrics(rows: DataFrame, metrics: list[str], group: str = "grp") -> DataFrame:
    """(metric, grp, value) without missing values."""
    wide = rows.select(F.col(group).alias("grp"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["grp"], metrics, "metric", "value").where("value is not null and not isnan(value)")


def group_stats(values: DataFrame) -> DataFrame:
    """n, mean, sample std, sem and median per metric and group; std and sem are 0 for one value."""
    std = F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(0.0)
    moments = values.groupBy(*BY).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), std.alias("std"), (std / F.sqrt(F.count("value"))).alias("sem"))
    return moments.join(exact_median(values, BY, "value"), BY, "left")


def _pairs(values: DataFrame) -> DataFrame:
    """Every pair of a metric's groups with the moments of both; one row per group takes part."""
    s = values.groupBy(*BY).agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n >= 2")
    a, b = (s.select("metric", *[F.col(c).alias(f"{c}_{side}") for c in ("grp", "n", "m", "v")]) for side in "ab")
    return a.join(b, "metric").where("grp_a < grp_b")


def cohens_d(values: DataFrame) -> DataFrame:
    """Effect size of every pair of groups by the pooled variance; 0 where that is 0."""
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return _pairs(values).select("metric", "grp_a", "grp_b", F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / pooled).otherwise(0.0).alias("d"))


def welch_t(values: DataFrame) -> DataFrame:
    """t and the Welch-Satterthwaite degrees of freedom of every pair of groups."""
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    df = (va + vb) ** 2 / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    ok = va + vb > 0
    return _pairs(values).select("metric", "grp_a", "grp_b", F.when(ok, (F.col("m_a") - F.col("m_b")) / F.sqrt(va + vb)).alias("statistic"), F.when(ok, df).alias("df1"))


def _rank_sums(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grp, r, n, ties, total): sums of average ranks and sizes, from one count per (keys, value, grp); no row is ranked by itself."""
    counts = values.groupBy(*keys, "value", "grp").agg(F.count("*").alias("t"))
    counts = counts.groupBy(*keys, "value").agg(F.sum("t").alias("t"), F.collect_list(F.struct("grp", "t")).alias("_g"))
    ties = counts.groupBy(*keys).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"), F.sum("t").cast("double").alias("total"))
    ranked = running_sum(counts, keys, "value", "t", "_below").select(*keys, (F.col("_below") + (F.col("t") + 1) / 2).alias("rank"), F.explode("_g").alias("_g"))
    return ranked.groupBy(*keys, "_g.grp").agg(F.sum(F.col("rank") * F.col("_g.t")).alias("r"), F.sum("_g.t").cast("double").alias("n")).join(ties, keys)


def mann_whitney_u(values: DataFrame, first: str, second: str) -> DataFrame:
    """U of the first of two groups, z of its tie- and continuity-corrected normal form (statistic), both sizes, and whether the groups are small and free of ties (exact)."""
    two = values.where(F.col("grp").isin(first, second))
    sums = _rank_sums(two, ["metric"])
    at = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    s = sums.groupBy("metric").agg(at("r", first).alias("r1"), at("n", first).alias("n1"), at("n", second).alias("n2"), F.max("ties").alias("ties"), F.max("total").alias("n"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mid = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    exact = (F.least("n1", "n2") <= SMALL) & (F.col("n1") * F.col("n2") <= PAIRS) & (F.col("ties") == 0)
    return s.where("n1 is not null and n2 is not null").select("metric", u.alias("u"), ((F.abs(u - mid) - 0.5) / sd).alias("statistic"), "n1", "n2", exact.alias("exact"))


def anova_oneway(values: DataFrame) -> DataFrame:
    """F and its degrees of freedom over a metric's groups of two values or more, three groups at least."""
    s = values.groupBy(*BY).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n >= 2")
    g = s.groupBy("metric").agg(F.count("*").cast("double").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") ** 2).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("nmm") - F.col("nm") ** 2 / F.col("n")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return g.where("k >= 3").select("metric", f.alias("statistic"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def kruskal_wallis(values: DataFrame) -> DataFrame:
    """Tie-corrected H over a metric's groups of two values or more, three groups at least."""
    sizes = values.groupBy(*BY).count().where("count >= 2").select(*BY)
    s = _rank_sums(values.join(sizes, BY, "left_semi"), ["metric"])
    g = s.groupBy("metric").agg(F.count("*").cast("double").alias("k"), F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), F.max("total").alias("n"), F.max("ties").alias("ties"))
    h = (12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)) / (1 - F.col("ties") / (F.col("n") ** 3 - F.col("n")))
    return g.where("k >= 3").select("metric", h.alias("statistic"), (F.col("k") - 1).alias("df1"))


def pairwise_bonferroni(values: DataFrame) -> DataFrame:
    """Welch p of every pair times the number of pairs, at most 1, with Cohen's d and a marker."""
    t = with_p(welch_t(values).select("*", F.lit("t").alias("kind"), F.lit(0.0).alias("df2")))
    t = t.join(cohens_d(values), ["metric", "grp_a", "grp_b"]).withColumn("k", F.count("*").over(W.partitionBy("metric")))
    p = F.least(F.lit(1.0), F.col("p") * F.col("k"))
    return t.select("metric", "grp_a", "grp_b", "statistic", p.alias("p"), "d", significance_marker(p).alias("marker"))


def group_comparison(values: DataFrame) -> DataFrame:
    """All tests that a metric's total number of groups calls for: Welch t and Mann-Whitney (statistic U, p exact for small groups without ties, kind u,
    else by the normal form, kind z) for two, ANOVA and Kruskal-Wallis for more. Groups with fewer than two values are left out of the tests but counted
    among the groups."""
    groups = values.groupBy("metric").agg(F.count_distinct("grp").alias("groups"), F.min("grp").alias("a"), F.max("grp").alias("b"))
    two = values.join(groups.where("groups = 2"), "metric").select("metric", F.when(F.col("grp") == F.col("a"), "a").otherwise("b").alias("grp"), "value")
    more = values.join(groups.where("groups > 2"), "metric", "left_semi")
    shape = lambda df, test, kind: df.select("metric", F.lit(test).alias("test"), F.lit(kind).alias("kind"), "statistic", *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in ("df1", "df2")])
    ranked = mann_whitney_u(two, "a", "b")
    small = lambda yes, no: F.when(F.col("exact"), F.col(yes)).otherwise(no)
    ranked = ranked.select("metric", F.lit("mann_whitney_u").alias("test"), F.when(F.col("exact"), "u").otherwise("z").alias("kind"), small("u", F.col("statistic")).alias("statistic"), small("n1", F.lit(0.0)).alias("df1"), small("n2", F.lit(0.0)).alias("df2"), "u")
    tests = shape(welch_t(two), "welch_t", "t").withColumn("u", F.lit(None).cast("double")).unionByName(ranked)
    tests = tests.unionByName(shape(anova_oneway(more), "anova", "f"), True).unionByName(shape(kruskal_wallis(more), "kruskal_wallis", "chi2"), True)
    return with_p(tests).select("metric", "test", "kind", F.coalesce("u", "statistic").alias("statistic"), "df1", "df2", "p", significance_marker(F.col("p")).alias("marker"))


def comparison_result(values: DataFrame) -> DataFrame:
    """The whole comparison of every metric in one table: its groups (part group), the tests between them (part test) and, for more than two groups, every pair (part pair).

    item names the group, the test or the pair; figures that a part does not have are null.
    """
    figures = ("n", "mean", "std", "sem", "median", "statistic", "p", "d", "marker")

    def part(df: DataFrame, name: str, item) -> DataFrame:
        kind = lambda c: "string" if c == "marker" else "long" if c == "n" else "double"
        return df.select("metric", F.lit(name).alias("part"), item.alias("item"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind(c)).alias(c) for c in figures])

    many = values.groupBy("metric").agg(F.count_distinct("grp").alias("groups")).where("groups > 2").select("metric")
    pairs = pairwise_bonferroni(values.join(many, "metric", "left_semi"))
    out = part(group_stats(values), "group", F.col("grp").cast("string")).unionByName(part(group_comparison(values), "test", F.col("test")))
    return out.unionByName(part(pairs, "pair", F.concat_ws("/", "grp_a", "grp_b")))


def comparison_text(tests: DataFrame) -> DataFrame:
    """One line per test, gathered per metric in the tests' order."""
    line = F.format_string("%s: %.4f (p=%.4g) %s", "test", "statistic", "p", "marker")
    lines = F.sort_array(F.collect_list(F.struct("test", line.alias("line"))))
    return tests.groupBy("metric").agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("report"))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution by Newton steps on erfc."""
    x = np.zeros_like(p)
    for _ in range(60):
        cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
        pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x = np.clip(x - np.clip((cdf - p) / np.maximum(pdf, 1e-12), -1, 1), -9, 9)
    return x


# Royston's polynomials (1995), constant term first: corrections of the two outer weights in 1/sqrt(n), and mean and log deviation of the
# transformed W in n (4 to 11 values) and log n (12 and more).
OUTER = ((0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
FEW_MEAN, FEW_DEVIATION, FEW_GAMMA = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MANY_MEAN, MANY_DEVIATION = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(terms: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(terms))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the sorted values: normal scores, of which the outer one (two, from 6 values on) is corrected and the rest scaled to unit length."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    whole, outer = float(m @ m), 1 if n <= 5 else 2
    a = m.copy()
    ends = [m[n - 1 - k] / math.sqrt(whole) + _polynomial(OUTER[k], 1 / math.sqrt(n)) for k in range(outer)]
    rest = (whole - 2 * sum(m[n - 1 - k] ** 2 for k in range(outer))) / (1 - 2 * sum(e * e for e in ends))
    a /= math.sqrt(rest)
    for k, e in enumerate(ends):
        a[n - 1 - k], a[k] = e, -e
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p for 3 to 5000 values; equal values give 1 and 1."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    x = (x - x.mean()) / (x[-1] - x[0])
    w = min(1.0, float(shapiro_weights(n) @ x) ** 2 / float(x @ x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    far = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _polynomial(FEW_GAMMA, n)
        if far >= gamma:
            return w, 0.0
        y, mean, deviation = -math.log(gamma - far), _polynomial(FEW_MEAN, n), math.exp(_polynomial(FEW_DEVIATION, n))
    else:
        y, mean, deviation = far, _polynomial(MANY_MEAN, math.log(n)), math.exp(_polynomial(MANY_DEVIATION, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2))


def normality_check(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, grp, n, w, p, normal) for groups of 3 to 5000 values; W 0 and p 1 otherwise.

    Larger groups are filtered out before any grouping, so no group above 5000 values reaches a task whole. W is that of Shapiro and Wilk with
    Royston's weights and p.
    """
    sizes = values.groupBy(*BY).agg(F.count("*").alias("n"))
    small = values.join(sizes.where("n between 3 and 5000"), BY)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["value"].to_numpy(float))
        return pd.DataFrame({"metric": [group["metric"].iat[0]], "grp": [group["grp"].iat[0]], "w": [w], "p": [p]})

    found = small.groupBy(*BY).applyInPandas(test, "metric string, grp string, w double, p double")
    out = sizes.join(found, BY, "left")
    return out.select(*BY, "n", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"), (F.coalesce("p", F.lit(1.0)) > alpha).alias("normal"))
