"""Source cascades: first valid source per frame, provenance, flanking frames, configuration choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_range(masks: DataFrame, first: int | None = None) -> DataFrame:
    """Every frame between the smallest (or first) and the largest one, dealt by ranges of 4096 frames."""
    ends = masks.agg((F.min("frame") if first is None else F.min(F.lit(first))).cast("long").alias("a"), F.max("frame").cast("long").alias("b"))
    blocks = ends.where("a is not null").select("a", "b", F.explode(F.sequence(F.expr("a div 4096"), F.expr("b div 4096"))).alias("k")).repartition("k")
    return blocks.select(F.explode(F.sequence(F.greatest("a", F.col("k") * 4096), F.least("b", F.col("k") * 4096 + 4095))).alias("frame"))


def first_valid_source(masks: DataFrame, min_area: float = 400.0, trust_last: bool = False) -> DataFrame:
    """Per frame the source of lowest priority number whose area reaches min_area, as provenance; 'failed' if none.

    With trust_last the last source of a frame is taken whatever its area. One aggregation, no join.
    """
    ok = F.col("area_px") >= min_area
    pick = F.min(F.when(ok, F.struct("priority", "source", "area_px")))
    last = F.max(F.struct("priority", "source", "area_px"))
    g = masks.groupBy("frame").agg(pick.alias("p"), last.alias("l"))
    p = F.coalesce("p", "l") if trust_last else F.col("p")
    return g.select("frame", F.coalesce(p["source"], F.lit("failed")).alias("provenance"), p["area_px"].alias("area_px"))


def failed_frames(masks: DataFrame, min_area: float = 400.0) -> DataFrame:
    """Frames of the range without a valid mask."""
    return frame_range(masks).join(masks.where(F.col("area_px") >= min_area).select(F.col("frame").cast("long").alias("frame")), "frame", "left_anti")


def provenance_stats(chosen: DataFrame) -> DataFrame:
    """Frames per provenance and their share."""
    n = chosen.groupBy("provenance").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("provenance", "n", (F.col("n") / F.col("total")).alias("share"))


def flanking_frames(chosen: DataFrame, bucket: int = 4096) -> DataFrame:
    """Nearest valid frame before and after every failed one, the blend weight of the later one, and the mode.

    Windows run inside ranges of `bucket` frames; the last valid frame before and the first one after a range come from one row a
    range, so no window holds more than a range.
    """
    c = chosen.select(F.col("frame").cast("long").alias("frame"), (F.col("provenance") != "failed").alias("ok")).withColumn("k", F.expr(f"frame div {bucket}"))
    good = F.when(F.col("ok"), F.col("frame"))
    ends = c.groupBy("k").agg(F.max(good).alias("hi"), F.min(good).alias("lo"))
    w = W.orderBy("k")
    ends = ends.select("k", F.last("hi", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("hi"), F.last("lo", True).over(W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)).alias("lo"))
    inside = W.partitionBy("k").orderBy("frame")
    back = W.partitionBy("k").orderBy(F.desc("frame"))
    c = c.withColumn("a", F.last(good, True).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("b", F.last(good, True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    c = c.where("not ok").join(ends, "k").select("frame", F.coalesce("a", "hi").alias("before"), F.coalesce("b", "lo").alias("after"))
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    alpha = F.when(both, (F.col("frame") - F.col("before")) / (F.col("after") - F.col("before")))
    return c.select("frame", "before", "after", alpha.alias("alpha"), F.when(both, "both").when(F.col("before").isNotNull(), "forward").when(F.col("after").isNotNull(), "backward").otherwise("none").alias("mode"))


def skip_by_provenance(original: DataFrame, refined: DataFrame, chosen: DataFrame, trusted: list[str]) -> DataFrame:
    """Original rows in frames of trusted provenance, refined rows elsewhere."""
    keep = chosen.where(F.col("provenance").isin(*trusted)).select("frame")
    return original.join(keep, "frame", "left_semi").unionByName(refined.join(keep, "frame", "left_anti"))


# Floor, drop_ok, drop_reject and near.
def config_select(scores: DataFrame, floor: float = 0.55, drop_ok: float = 0.05, drop_reject: float = 0.2, near: float = 0.85) -> DataFrame:
    """Per recording the least aggressive configuration within `near` of the best score = quality * stability.

    Stability is 1 up to an IoU drop of drop_ok from the baseline (the lowest config_id, which always competes), falls to 0 at
    drop_reject, and an IoU under floor scores 0. Among the near-best the smallest search wins, then the highest score,
    then the lowest id.
    """
    over = W.partitionBy("recording_id")
    base = F.min(F.struct("config_id", "iou", "quality")).over(over)
    s = scores.withColumn("_b", base)
    is_base = F.col("config_id") == F.col("_b.config_id")
    drop = F.greatest(F.lit(0.0), F.col("_b.iou") - F.col("iou"))
    stability = F.when(drop <= drop_ok, 1.0).when(drop >= drop_reject, 0.0).otherwise(1.0 - (drop - drop_ok) / (drop_reject - drop_ok))
    score = F.when(is_base, F.col("quality")).when(F.col("iou") < floor, 0.0).otherwise(F.col("quality") * stability)
    s = s.withColumn("score", score).withColumn("_best", F.max("score").over(over)).where(F.col("score") >= near * F.col("_best"))
    r = F.row_number().over(over.orderBy("search", F.desc("score"), "config_id"))
    return s.withColumn("_r", r).where("_r = 1").select("recording_id", "config_id", "search", "score")


def config_select_floor(scores: DataFrame, floor: float = 0.4) -> DataFrame:
    """Per recording the configuration of highest quality with IoU >= floor, if strictly better than the baseline's; else the baseline."""
    ok = F.when(F.col("iou") < floor, F.lit(0.0)).otherwise(F.col("quality"))
    g = scores.groupBy("recording_id").agg(F.min(F.struct("config_id", "quality")).alias("b"), F.max(F.struct(ok.alias("q"), (-F.col("config_id")).alias("id"))).alias("m"))
    better = F.col("m.q") > F.col("b.quality")
    return g.select("recording_id", F.when(better, -F.col("m.id")).otherwise(F.col("b.config_id")).alias("config_id"), F.when(better, F.col("m.q")).otherwise(F.col("b.quality")).alias("quality"))
