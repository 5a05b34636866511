"""Primitives shared by many operators: frame spines, kernels over an ordered index, gap filling, average ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.staging import staged

#: Scale of the examples: micrometres per pixel and minutes per frame.
UM_PER_PX, MINUTES = 0.65, 5.0


def null_nan(df: DataFrame) -> DataFrame:
    """NaN of every float column becomes null, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def frame_spine(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Every frame from 0 to the largest one for each key."""
    return df.groupBy(*keys).agg(F.max(frame).alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias(frame))


def gaussian_weights(sigma: float) -> list[float]:
    """Weights at offsets -r..r, r = int(4 sigma + 0.5), summing to 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def reflected(index: Column, n: Column) -> Column:
    """index mirrored into 0..n-1 about the edges, the edge value repeated (d c b a | a b c d | d c b a)."""
    m = F.pmod(index, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def convolve(df: DataFrame, keys: list[str], index: str, values: list[str], weights: list[float], keep: list[str] | None = None) -> DataFrame:
    """Weighted sums along a dense index 0..n-1 within each key, reflected at the ends; nulls are left out of the sums, and columns of keep stay as they are.

    A mirrored index is never farther from its row than the one it stands for, so a sliding frame of the kernel's
    length holds all that a row needs: one shuffle by key, and no more than a frame in memory.
    """
    r = len(weights) // 2
    line = W.partitionBy(*keys).orderBy(index)
    near = F.collect_list(F.struct(*values)).over(line.rowsBetween(-r, r))
    rows = df.select(*keys, index, *(keep or []), near.alias("_near"), F.count("*").over(W.partitionBy(*keys)).alias("_n"))
    at = [F.get("_near", (reflected(F.col(index) + k - r, F.col("_n")) - F.greatest(F.col(index) - r, F.lit(0))).cast("int")) for k in range(len(weights))]

    def total(v: str) -> Column:
        parts = [x[v] * w for x, w in zip(at, weights)]
        return F.when(F.exists("_near", lambda x: x[v].isNotNull()), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))
    return rows.select(*keys, index, *(keep or []), *[total(v).alias(v) for v in values])


def fill_linear(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """out: value, or the straight line between the valid neighbours; beyond the ends the nearest valid value."""
    w = W.partitionBy(*keys).orderBy(order)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    before = F.last(pair, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.last(pair, ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_b", before).withColumn("_a", after)
    share = (F.col(order) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
    return df.withColumn(out, F.coalesce(F.col(value), F.when(F.col("_b.t").isNotNull() & F.col("_a.t").isNotNull(), line), F.col("_b.v"), F.col("_a.v"))).drop("_b", "_a")


def value_bucket(value: Column, bounds: Column, most: int) -> Column:
    """Number of sorted bounds not above value, by binary search; most is the largest length of bounds."""
    steps = [1 << j for j in range(max(1, most).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= F.size(bounds)) & (F.get(bounds, at + s - 1) <= value), at + s).otherwise(at))


def running_sum(df: DataFrame, keys: list[str], order: str, amount: str, out: str, buckets: int | None = None) -> DataFrame:
    """df with out, the sum of amount over the rows of the key before this one in the order of a numeric column.

    Orders are unique within a key. Each key's values are cut at quantiles into buckets (four for each shuffle partition, 64 at
    least, so they grow with the cluster that the input asks for), bucket totals (buckets rows a key) get prefix sums, and
    windows run inside (key, bucket): no task orders a whole key. The quantiles are approximate and depend on the order in which their parts
    arrive, so they are staged: totals and rows see the same buckets, and a small table of cuts is broadcast instead of dealing rows by key.
    """
    buckets = buckets or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 20 * buckets)).alias("_cuts"))
    b = df.join(staged(cuts, "cuts"), keys).withColumn("_bucket", value_bucket(F.col(order), F.col("_cuts"), buckets)).drop("_cuts")
    totals = b.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_t"))
    start = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("_in", inside).join(totals.select(*keys, "_bucket", start.alias("_start")), [*keys, "_bucket"])
    return b.withColumn(out, F.col("_in") + F.col("_start")).drop("_bucket", "_in", "_start")


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with rank (ties share their mean rank) and ties (rows of equal value), from running counts over distinct values.

    Ties are counted before the shuffle, and the running counts are distributed (running_sum).
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    ranked = running_sum(counts, keys, value, "ties", "_below").select(*keys, value, "ties", (F.col("_below") + (F.col("ties") + 1) / 2).alias("rank"))
    return df.join(ranked, [*keys, value])
