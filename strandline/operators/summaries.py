"""Metric rows, group summaries and related aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.quantiles import exact_quantiles


def group_summary(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """n and mean, std, sem of every metric per group. std is the sample deviation, 0 for one value, null without values;
    the sem divides by the root of the group's rows, missing values included."""
    aggs: list[Column] = [F.count("*").alias("n")]
    for m in metrics:
        std = F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m))
        aggs += [F.avg(m).alias(f"{m}_mean"), std.alias(f"{m}_std"), (std / F.sqrt(F.count("*"))).alias(f"{m}_sem")]
    return rows.groupBy(group).agg(*aggs)


def shape_summary(series: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """mean, population std, min and max of each metric over frames, as (keys, metric, ...) rows; nulls are ignored."""
    long = series.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def recording_from_cells(cells: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Recording value = mean over its cells, with the number of cells."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), *[F.avg(m).alias(m) for m in metrics])


def metric_values(rows: DataFrame, group: str, metrics: list[str], absent: dict[str, float] | None = None) -> DataFrame:
    """(metric, group, value): metrics named in absent stand for keys that may lack and get their default; other
    nulls are dropped; metrics left with fewer than two groups are dropped."""
    filled = rows.select(group, *[F.coalesce(F.col(m).cast("double"), F.lit((absent or {}).get(m))).alias(m) for m in metrics])
    long = filled.unpivot([group], metrics, "metric", "value").where("value is not null")
    enough = long.groupBy("metric").agg(F.count_distinct(group).alias("k")).where("k >= 2").select("metric")
    return long.join(enough, "metric", "left_semi").select("metric", group, "value")


def metric_pivot(rows: DataFrame, group: str, metrics: list[str], groups: list) -> DataFrame:
    """metric x group table of means."""
    return rows.unpivot([group], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").groupBy("metric").pivot(group, groups).agg(F.avg("value"))


def box_stats(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers per group (whiskers end at the farthest value inside); violin tells whether n >= 2."""
    sizes = rows.where(F.col(metric).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    q = sizes.join(exact_quantiles(rows, [group], metric, {"q1": 0.25, "median": 0.5, "q3": 0.75}), group)
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(metric).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    ends = rows.where(F.col(metric).isNotNull()).join(q, group).groupBy(group).agg(F.min(F.when(inside, F.col(metric))).alias("low"), F.max(F.when(inside, F.col(metric))).alias("high"))
    return q.join(ends, group).withColumn("violin", F.col("n") >= 2)


def batch_status(log: DataFrame) -> DataFrame:
    """Entries, first and last time of every kind in a run log, and the share of all entries."""
    by = log.groupBy("kind").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return by.join(by.agg(F.sum("n").alias("total"))).select("kind", "n", "first_ts", "last_ts", (F.col("n") / F.col("total")).alias("share"))
