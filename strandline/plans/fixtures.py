"""Views over the driver's tables that stand for tracking data, in Spark SQL and in DuckDB's dialect (FIXTURES.md)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPARK = {
    "config_scores": r"""
SELECT p_brand AS recording_id, p_partkey AS config_id, p_size AS search,
       p_retailprice / 100 AS quality, CAST(0.4 AS DOUBLE) + CAST(p_partkey % 50 AS DOUBLE) / 100 AS iou
FROM part""",
    "detections": r"""
SELECT recording_id, frame,
       CAST(row_number() OVER (PARTITION BY recording_id, frame ORDER BY event_id) AS INT) AS label,
       cy, cx, area_px
FROM (SELECT event_id, event_type AS recording_id, CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP'2024-01-01 00:00:00')) / 3600000000) AS INT) AS frame,
             value AS cy, 5 * CAST(get_json_object(props,'$.k') AS DOUBLE) AS cx, 200 + event_id % 1800 AS area_px FROM events) e""",
    "mask_px": r"""
WITH b AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS frame FROM part), o AS (
SELECT p_brand AS recording_id, frame, label, r, c, h, w, p_size FROM (
  SELECT p_brand, p_partkey, frame, 1 AS label, 20 + frame % 20 + p_size % 3 AS r, 20 + 2 * (frame % 10) AS c, 3 + p_size % 8 AS h, CAST(3 + p_partkey % 5 AS INT) AS w, p_size FROM b
  UNION ALL
  SELECT p_brand, p_partkey, frame, 2, 23 + frame % 20 + p_size % 3, 31 + 2 * (frame % 10), CAST(3 + p_partkey % 5 AS INT), 3 + p_size % 8, p_size FROM b WHERE p_size % 2 = 1) o
WHERE p_partkey % 13 <> 0) SELECT recording_id, frame, label, r + dr AS row_, c + dc AS col_ FROM o
 LATERAL VIEW explode(sequence(-10, 10)) a AS dr LATERAL VIEW explode(sequence(-10, 10)) q AS dc
 WHERE dr * dr * w * w + dc * dc * h * h <= h * h * w * w
 AND NOT (p_size % 4 = 0 AND 4 * (dr * dr * w * w + dc * dc * h * h) < h * h * w * w) AND NOT (p_size % 8 = 4 AND dr = 0 AND dc > 0)""",
    "media_files": r"""
SELECT concat('/exp/', CASE WHEN s_nationkey % 2 = 0 THEN 'control' ELSE 'treated' END, '/cell_',
       lpad(CAST(s_suppkey AS VARCHAR(20)), 4, '0'),
       CASE s_suppkey % 4 WHEN 0 THEN '_masks.png' WHEN 1 THEN '.tif' WHEN 2 THEN '.mp4' ELSE '.json' END) AS path
FROM supplier""",
    "pixels": r"""
SELECT CAST(label AS INT) AS recording_id, frame, CAST(floor(pos / 8.0) AS INT) AS row_, CAST(pos % 8 AS INT) AS col_,
       CAST(least(255, greatest(0, floor(128 + 400 * CAST(x AS DOUBLE)))) AS DOUBLE) AS intensity
FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM embeddings) v
LATERAL VIEW posexplode(embedding) t AS pos, x""",
    "recording_metrics": r"""
SELECT o_orderkey AS recording_id, o_orderpriority AS grp, o_orderstatus AS cohort,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS mean_speed,
       CAST(o_custkey % 97 AS DOUBLE) AS mean_area,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) END AS n_cells
FROM orders""",
    "recordings": r"""
SELECT s_suppkey AS recording_id, CAST(s_nationkey % 3 AS INT) AS grp, s_name AS name,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(0.65 AS DOUBLE) END AS um_per_px,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) END AS time_interval_min
FROM supplier""",
    "run_log": r"""
SELECT ts, event_type AS kind, concat('user ', CAST(user_id AS VARCHAR(20))) AS message, props AS details FROM events""",
    "shape_vectors": r"""
SELECT vec_id, CAST(label AS INT) AS mode_id, embedding AS v FROM embeddings""",
    "source_masks": r"""
SELECT l_orderkey AS frame, l_returnflag AS source,
       CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS INT) AS priority,
       max(l_quantity) * 20 AS area_px
FROM lineitem GROUP BY l_orderkey, l_returnflag""",
    "track_lives": r"""
SELECT l_suppkey AS recording_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INT) AS track_id,
       CAST(l_partkey % 100 AS INT) AS first_frame,
       CAST(l_partkey % 100 + l_quantity AS INT) AS last_frame,
       l_extendedprice / 100 AS first_cy, l_discount * 1000 AS first_cx,
       l_extendedprice / 100 + l_tax * 100 AS last_cy, l_discount * 1000 + l_linenumber AS last_cx,
       100 + l_partkey % 400 AS first_area, 100 + l_orderkey % 900 AS last_area
FROM lineitem""",
    "track_points": r"""
SELECT event_type AS recording_id, user_id AS track_id, frame,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS cy,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE k END AS cx,
       CAST(user_id % 3 AS INT) AS grp
FROM (SELECT *, CAST(get_json_object(props,'$.k') AS DOUBLE) AS k,
        CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS frame
      FROM events) e""",
}

DUCKDB = {
    "detections": r"""
SELECT recording_id, frame,
       CAST(row_number() OVER (PARTITION BY recording_id, frame ORDER BY event_id) AS INT) AS label,
       cy, cx, area_px
FROM (SELECT event_id, event_type AS recording_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000) AS INT) AS frame,
             value AS cy, 5 * CAST(json_extract_string(props,'$.k') AS DOUBLE) AS cx, 200 + event_id % 1800 AS area_px FROM events) e""",
    "mask_px": r"""
WITH b AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS frame FROM part), o AS (
SELECT p_brand AS recording_id, frame, label, r, c, h, w, p_size FROM (
  SELECT p_brand, p_partkey, frame, 1 AS label, 20 + frame % 20 + p_size % 3 AS r, 20 + 2 * (frame % 10) AS c, 3 + p_size % 8 AS h, CAST(3 + p_partkey % 5 AS INT) AS w, p_size FROM b
  UNION ALL
  SELECT p_brand, p_partkey, frame, 2, 23 + frame % 20 + p_size % 3, 31 + 2 * (frame % 10), CAST(3 + p_partkey % 5 AS INT), 3 + p_size % 8, p_size FROM b WHERE p_size % 2 = 1) o
WHERE p_partkey % 13 <> 0) SELECT recording_id, frame, label, r + dr AS row_, c + dc AS col_ FROM o,
 (SELECT CAST(range AS INT) AS dr FROM range(-10, 11)) a, (SELECT CAST(range AS INT) AS dc FROM range(-10, 11)) q
 WHERE dr * dr * w * w + dc * dc * h * h <= h * h * w * w
 AND NOT (p_size % 4 = 0 AND 4 * (dr * dr * w * w + dc * dc * h * h) < h * h * w * w) AND NOT (p_size % 8 = 4 AND dr = 0 AND dc > 0)""",
    "pixels": r"""
SELECT CAST(label AS INT) AS recording_id, frame, CAST(floor(pos / 8.0) AS INT) AS row_, CAST(pos % 8 AS INT) AS col_,
       CAST(least(255, greatest(0, floor(128 + 400 * CAST(x AS DOUBLE)))) AS DOUBLE) AS intensity
FROM (SELECT label, frame, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x
      FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, embedding FROM embeddings) v) w""",
    "track_points": r"""
SELECT event_type AS recording_id, user_id AS track_id, frame,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS cy,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE k END AS cx,
       CAST(user_id % 3 AS INT) AS grp
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k,
        CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS frame
      FROM events) e""",
}


#: Rows of part that one task turns into pixels, some hundred each.
PARTS_A_TASK = 10_000


def mask_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of SPARK["mask_px"], dealt by frame before a part becomes pixels.

    In the SQL the pixels of all frames come out of the tasks that number the frames, one a recording or fewer. Here frames are numbered over
    narrow rows and then dealt, so that all that is grouped by frame or object needs no further shuffle. Row offsets are a table that is
    joined, not an array, so that the plan's size estimate grows with the pixels and no table of them is broadcast.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-part.count() // PARTS_A_TASK))
    number = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    b = part.select(F.col("p_brand").alias("recording_id"), number.cast("int").alias("frame"), "p_partkey", "p_size").where("p_partkey % 13 <> 0").repartition(tasks, "recording_id", "frame")
    one = "named_struct('label', 1, 'r', 20 + frame % 20 + p_size % 3, 'c', 20 + 2 * (frame % 10), 'h', 3 + p_size % 8, 'w', CAST(3 + p_partkey % 5 AS INT))"
    two = "named_struct('label', 2, 'r', 23 + frame % 20 + p_size % 3, 'c', 31 + 2 * (frame % 10), 'h', CAST(3 + p_partkey % 5 AS INT), 'w', 3 + p_size % 8)"
    o = b.selectExpr("recording_id", "frame", "p_size", f"explode(CASE WHEN p_size % 2 = 1 THEN array({one}, {two}) ELSE array({one}) END) AS o").select("recording_id", "frame", "p_size", "o.*")
    rows = spark.range(-10, 11, 1, 1).select(F.col("id").cast("int").alias("dr"))
    o = o.join(F.broadcast(rows), F.abs("dr") <= F.col("h")).withColumn("dc", F.explode(F.sequence(-F.col("w"), F.col("w"))))
    inside = """dr * dr * w * w + dc * dc * h * h <= h * h * w * w
        AND NOT (p_size % 4 = 0 AND 4 * (dr * dr * w * w + dc * dc * h * h) < h * h * w * w) AND NOT (p_size % 8 = 4 AND dr = 0 AND dc > 0)"""
    return o.where(inside).selectExpr("recording_id", "frame", "label", "r + dr AS row_", "c + dc AS col_")


TABLES = ("supplier", "part", "orders", "lineitem", "events", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the Parquet tables of sf_dir."""
    if name == "mask_px":
        return mask_px(spark, sf_dir)
    sql = SPARK[name]
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def duckdb_with(*names: str) -> str:
    """A WITH clause that defines the named views in DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({DUCKDB.get(n, SPARK[n])})" for n in names)
