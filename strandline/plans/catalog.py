"""Registered queries of the tracking operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import summaries, tracks
from strandline.plans import q_linking, q_masks, q_pixels, q_stats, q_tables, q_tracks  # noqa: F401
from strandline.plans.fixtures import view
from strandline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do treated objects move faster than controls? One row per group: n, mean speed, std, sem, mean persistence."""
    points = view(spark, sf_dir, "track_points")
    groups = points.select("recording_id", "track_id", "grp").distinct()
    per_track = tracks.analyze_recording(points).join(groups, ["recording_id", "track_id"])
    speed = summaries.group_summary(per_track, "grp", ["mean_speed", "persistence"])
    return speed.orderBy(F.col("grp"))
