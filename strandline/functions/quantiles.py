"""Exact quantiles of groups of any size: selection over running counts of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.primitives import running_sum
from strandline.functions.staging import staged


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names of shares): the quantile of every share (0 to 1) on the line between the two values around its place; nulls and NaN are left out, and keys without other values have nulls.

    Values are counted before the shuffle and staged, so that df is computed once; running counts over distinct values are distributed (running_sum), and each quantile picks the values
    whose counts span its two places. No task holds a key's values.
    """
    v = F.col(value).cast("double")
    seen = df.select(*keys, F.when(~F.isnan(v), v).alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_t"))
    seen = staged(seen, "counts")
    counts = seen.where("_v is not null")
    sizes = counts.groupBy(*keys).agg(F.sum("_t").alias("_size"))
    placed = running_sum(counts, keys, "_v", "_t", "_below").join(sizes, keys)
    picked, out = [], []
    for k, (name, share) in enumerate(shares.items()):
        place = (F.col("_size") - 1) * F.lit(float(share))
        for side, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            picked.append(F.max(F.when((F.col("_below") <= at) & (at < F.col("_below") + F.col("_t")), F.col("_v"))).alias(f"_{side}{k}"))
        low, high = F.col(f"_a{k}"), F.col(f"_b{k}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return seen.select(*keys).distinct().join(placed.groupBy(*keys, "_size").agg(*picked).select(*keys, *out), keys, "left")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
