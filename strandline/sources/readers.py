"""Readers of recordings, sidecars, masks, metrics, checkpoints and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.sinks import LOG_TIMES

# File types of recordings.
VIDEO = ("mp4", "avi", "mov", "tif", "tiff")

SIDECAR = T.StructType([T.StructField("name", T.StringType()), T.StructField("um_per_px", T.DoubleType()), T.StructField("time_interval_min", T.DoubleType())])

PARAMS = T.StructType([
    T.StructField("min_area_px", T.IntegerType()), T.StructField("max_hop_px", T.DoubleType()), T.StructField("um_per_px", T.DoubleType()),
    T.StructField("time_interval_min", T.DoubleType()), T.StructField("n_sectors", T.IntegerType()), T.StructField("refine", T.BooleanType()),
])

# Defaults of the parameters above.
DEFAULTS = {"min_area_px": 200, "max_hop_px": 150.0, "um_per_px": 1.0, "time_interval_min": 1.0, "n_sectors": 72, "refine": True}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def recordings_of(files: DataFrame) -> DataFrame:
    """(grp, name, path) of the video files of a table with a path column; grp is the parent folder, 'root' without one."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    folders = F.filter(F.split("path", "/"), lambda x: x != "")
    grp = F.coalesce(F.nullif(F.when(F.size(folders) > 1, F.element_at(folders, -2)), F.lit("")), F.lit("root"))
    return files.where(ext.isin(*VIDEO)).select(grp.alias("grp"), file_name(stem(F.col("path"))).alias("name"), "path")


def scan_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Video files under root. Only paths and sizes are read: the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return recordings_of(files).join(files, "path")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """JSON metadata files under root as (stem, name, um_per_px, time_interval_min), missing keys null; unreadable files too."""
    rows = spark.read.schema(SIDECAR).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(root)
    return rows.select(stem(F.input_file_name()).alias("stem"), "*")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Name from the path where it is missing, and scale 1.0, 1.0."""
    name = [F.col("name")] + ([file_name(stem(F.col("path")))] if "path" in rows.columns else [])
    return rows.withColumns({"name": F.coalesce(*name), "um_per_px": F.coalesce("um_per_px", F.lit(1.0)), "time_interval_min": F.coalesce("time_interval_min", F.lit(1.0))})


def build_recordings(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row per recording: identity from the file, scale and name from the sidecar of the same stem."""
    r = files.select("grp", "path", stem(F.col("path")).alias("stem"))
    s = sidecars.select(F.regexp_replace("stem", "^file:/*", "/").alias("stem"), "name", "um_per_px", "time_interval_min")
    return with_defaults(r.withColumn("stem", F.regexp_replace("stem", "^file:/*", "/")).join(s, "stem", "left")).select("grp", "name", "path", "um_per_px", "time_interval_min")


def scale_override(recordings: DataFrame, um_per_px: float | None = None, minutes: float | None = None) -> DataFrame:
    """User values replace the recording's where they are above 0."""
    given = {"um_per_px": um_per_px, "time_interval_min": minutes}
    return recordings.withColumns({c: F.when(F.lit(v) > 0, F.lit(v)).otherwise(F.col(c)) if v is not None else F.col(c) for c, v in given.items()})


def read_masks(rows: DataFrame) -> DataFrame:
    """Saved masks with an integer label: column label, else mask (boolean or number), else the first other column."""
    extra = [c for c in rows.columns if c not in ("recording_id", "frame", "row_", "col_")]
    best = next((c for c in ("label", "labels", "masks", "mask") if c in extra), extra[0])
    return rows.select("recording_id", "frame", F.col(best).cast("int").alias("label"), "row_", "col_").where("label > 0")


def index_mask_files(files: DataFrame, n_frames: int | None = None) -> DataFrame:
    """Frame number of every file name: its last integer, or the last but one where the name holds 'masks' and has two."""
    name = file_name(F.col("path"))
    numbers = F.regexp_extract_all(stem(name), F.lit(r"(\d+)"), F.lit(1))
    masks = F.contains(name, F.lit("masks"))
    at = F.when(masks & (F.size(numbers) > 1), F.element_at(numbers, -2)).when(F.size(numbers) > 0, F.element_at(numbers, -1))
    out = files.select("path", at.cast("int").alias("frame")).where("frame is not null")
    return out if n_frames is None else out.where(F.col("frame") < n_frames)


def pair_training_files(files: DataFrame) -> DataFrame:
    """(image, mask) paths of the same base name; only where no name matches, of the same last number.

    Of several masks the lowest name is taken.
    """
    name = stem(file_name(F.col("path")))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    base = F.concat_ws("/", folder, F.regexp_replace(name, "_masks?$", ""))
    number = F.regexp_extract(name, r"(\d+)\D*$", 1)
    rows = files.select("path", base.alias("base"), F.nullif(number, F.lit("")).alias("number"), F.rlike(name, F.lit("_masks?$")).alias("is_mask"))
    images, masks = rows.where("not is_mask"), rows.where("is_mask")
    lowest = lambda key: masks.where(f"{key} is not null").groupBy(key).agg(F.min("path").alias("mask"))
    named = images.join(lowest("base"), "base").select(F.col("path").alias("image"), "mask")
    numbered = images.join(lowest("number"), "number").select(F.col("path").alias("image"), "mask")
    some = named.limit(1).agg(F.count("*").alias("some"))
    return named.unionByName(numbered.join(F.broadcast(some)).where("some = 0").drop("some"))


def read_metrics(documents: DataFrame, schema: T.StructType, column: str = "document") -> DataFrame:
    """Label / value rows of JSON metric documents: top-level numbers by name, nested ones as parent.child."""
    parsed = documents.withColumn("_m", F.from_json(column, schema))
    pairs = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            pairs += [(f"{f.name}.{g.name}", F.col(f"_m.{f.name}.{g.name}")) for g in f.dataType.fields if isinstance(g.dataType, T.NumericType)]
        elif isinstance(f.dataType, T.NumericType):
            pairs.append((f.name, F.col(f"_m.{f.name}")))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in pairs]))
    keep = [c for c in documents.columns if c != column]
    return parsed.select(*keep, rows.alias("_r")).select(*keep, "_r.label", "_r.value", F.format_number("_r.value", 4).alias("shown")).where("value is not null")


def params_record(rows: DataFrame, column: str = "params") -> DataFrame:
    """Parameters parsed from JSON with defaults for missing keys, and written back as JSON."""
    parsed = rows.withColumn("_p", F.from_json(column, PARAMS))
    filled = F.struct(*[F.coalesce(F.col(f"_p.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])
    return parsed.withColumn("record", filled).withColumn("json", F.to_json("record")).drop("_p")


def load_detection(spark: SparkSession, path: str) -> DataFrame:
    """A detection checkpoint with defaults for the optional parts of older versions."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    for name, default in (("provenance", F.lit("primary")), ("version", F.lit(1)), ("kind", F.lit("detection"))):
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    return rows


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events that append_log wrote; their kind is the folder's name."""
    return spark.read.schema(schema).options(**LOG_TIMES).json(path)


def latest_log(log: DataFrame) -> DataFrame:
    """The last entry of every kind."""
    return log.withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("ts"), "message"))).where("_r = 1").drop("_r")
