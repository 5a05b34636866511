"""Writers of metric documents, summaries, checkpoints and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.summaries import group_summary

# The columns of a batch summary, in their order.
SCALAR_COLUMNS = [
    "group", "name", "n_frames", "mean_speed_um_min", "total_distance_um", "net_displacement_um", "persistence", "mean_area_um2", "area_cv", "n_large_jumps",
    "mean_consec_iou", "mean_boundary_confidence", "mean_protrusion_velocity_um_min", "mean_retraction_velocity_um_min", "protrusion_fraction",
    "net_edge_velocity_um_min", "max_protrusion_um_min", "max_retraction_um_min", "refinement_chosen",
]


def recording_metrics(rows: DataFrame) -> DataFrame:
    """The summary columns of rows in order: absent ones null, the configuration name '?' where missing."""
    out = [F.col(c) if c in rows.columns else F.lit(None).cast("string" if c in ("group", "name", "refinement_chosen") else "double").alias(c) for c in SCALAR_COLUMNS]
    return rows.select(*out).withColumn("refinement_chosen", F.coalesce("refinement_chosen", F.lit("?")))


def metrics_documents(rows: DataFrame, keys: list[str], nested: dict[str, list[str]]) -> DataFrame:
    """One JSON document per row: keys and plain columns on top, the columns of `nested` as objects; nulls are left out."""
    inside = {c for cs in nested.values() for c in cs}
    plain = [F.col(c) for c in rows.columns if c not in inside]
    groups = [F.struct(*[F.col(c) for c in cs]).alias(k) for k, cs in nested.items()]
    return rows.select(*keys, F.to_json(F.struct(*plain, *groups), {"ignoreNullFields": "true"}).alias("document"))


def export_metrics_subset(rows: DataFrame, wanted: list[str], keys: list[str]) -> DataFrame:
    """Documents with those of the wanted columns that exist."""
    return metrics_documents(rows.select(*keys, *[c for c in wanted if c in rows.columns and c not in keys]), keys, {})


def write_documents(documents: DataFrame, path: str, by: str) -> None:
    documents.select(by, F.col("document").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def batch_summary_csv(rows: DataFrame, path: str) -> None:
    """One CSV row per recording in the fixed order of columns."""
    recording_metrics(rows).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def per_cell_csv(rows: DataFrame, path: str) -> None:
    """One folder per recording with its per-cell rows in order of frame; missing figures are empty."""
    rows.repartition("recording_id").sortWithinPartitions("recording_id", "frame").write.mode("overwrite").partitionBy("recording_id").option("header", True).option("nullValue", "").csv(path)


def group_summary_csv(rows: DataFrame, group: str, metrics: list[str], path: str) -> None:
    """path/groups: the summary of every group; path/recordings: the recordings' rows, one folder per group."""
    group_summary(rows, group, metrics).orderBy(group).write.mode("overwrite").option("header", True).csv(f"{path}/groups")
    rows.write.mode("overwrite").partitionBy(group).option("header", True).csv(f"{path}/recordings")


def save_detection(masks: DataFrame, path: str, version: int = 2, kind: str = "detection") -> None:
    """Masks with provenance, version and kind, partitioned by recording."""
    masks.withColumn("version", F.lit(version)).withColumn("kind", F.lit(kind)).write.mode("overwrite").partitionBy("recording_id").parquet(path)


def project_records(rows: DataFrame, masks_path: str, version: int = 1) -> DataFrame:
    """Analysis state per recording as one JSON document that refers to its mask partition."""
    state = F.struct(F.lit(version).alias("version"), F.struct(*rows.columns).alias("state"), F.concat(F.lit(f"{masks_path}/recording_id="), F.col("recording_id").cast("string")).alias("masks"))
    return rows.select("recording_id", F.to_json(state).alias("document"))


def log_markdown(log: DataFrame) -> DataFrame:
    """Markdown lines of a run log per kind, in order of time."""
    line = F.concat(F.lit("- **"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("** "), F.col("message"))
    return log.select("kind", "ts", line.alias("line"))


#: Times of a log keep their microseconds.
LOG_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_log(log: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per kind."""
    log.write.mode("append").options(**LOG_TIMES).partitionBy("kind").json(path)
