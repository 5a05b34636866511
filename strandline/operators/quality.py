"""Quality figures of mask series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from strandline.functions.primitives import UM_PER_PX, frame_spine
from strandline.operators.masks import FRAME, consecutive_iou
from strandline.operators.words import pixel_words


def along() -> WindowSpec:
    """The frames of a recording in order."""
    return W.partitionBy("recording_id").orderBy("frame")


def frame_areas(px: DataFrame) -> DataFrame:
    """Foreground pixels of every occupied frame."""
    return pixel_words(px, FRAME).groupBy(*FRAME).agg(F.sum(F.bit_count("bits")).alias("n"))


def area_stability(px: DataFrame, um: float = UM_PER_PX) -> DataFrame:
    """Mean area, population CV, max / min, number of jumps over 30 % between consecutive occupied frames, mean IoU;
    nulls and 0 jumps with fewer than two occupied frames."""
    a = frame_areas(px).withColumn("area", F.col("n") * um * um).withColumn("prev", F.lag("area").over(along()))
    jump = F.abs(F.col("area") - F.col("prev")) / (F.col("prev") + 1) > 0.3
    s = a.groupBy("recording_id").agg(F.count("*").alias("k"), F.avg("area").alias("m"), F.stddev_pop("area").alias("s"), F.max("area").alias("hi"), F.min("area").alias("lo"), F.count(F.when(jump, 1)).alias("jumps"))
    iou = consecutive_iou(px).where("filled").groupBy("recording_id").agg(F.avg("iou").alias("iou"))
    two = lambda c: F.when(F.col("k") >= 2, c)
    return s.join(iou, "recording_id", "left").select(
        "recording_id", two(F.col("m")).alias("mean_area_um2"), two(F.col("s") / F.col("m")).alias("area_cv"), two(F.col("hi") / F.col("lo")).alias("max_min_ratio"),
        F.coalesce(two(F.col("jumps")), F.lit(0)).alias("n_large_jumps"), two(F.col("iou")).alias("mean_consec_iou"))


def suspect_frames(px: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Relative area change of every frame from the one before (1 beside an empty frame), and whether it is suspect: a
    change above the threshold, or a lost object. A reappearing object is not."""
    s = frame_spine(px, ["recording_id"]).join(frame_areas(px), FRAME, "left").fillna(0, ["n"]).withColumn("a", F.lag("n").over(along())).where("a is not null")
    both = (F.col("a") > 0) & (F.col("n") > 0)
    change = F.when(both, F.abs(F.col("n") - F.col("a")) / F.col("a")).otherwise(1.0)
    lost, jump = (F.col("n") == 0) & (F.col("a") > 0), both & (change > threshold)
    reason = F.when(lost, "lost").when(jump, F.concat(F.lit("area "), "a", F.lit(" -> "), "n"))
    return s.select(*FRAME, change.alias("area_change"), (lost | jump).alias("suspect"), reason.alias("reason"))
