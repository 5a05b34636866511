"""Queries of sources, sinks, streaming and user functions over tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.staging import shared_dir
from strandline.operators import assembled
from strandline.operators import masks as M
from strandline.operators import objects as O
from strandline.operators import pixels as P
from strandline.operators import tracks
from strandline.plans.fixtures import duckdb_with, view
from strandline.plans.q_masks import BIG, DESCR, SHAPES
from strandline.plans.q_tracks import STEPS, rounded
from strandline.plans import q_linking, q_masks, q_pixels  # noqa: F401
from strandline.plans.registry import ORACLE_SQL, QUERIES, query
from strandline.sources import readers as R
from strandline.sources import sinks as K
from strandline.streaming import sessions as S

FILES, REC, LOG, RM, PX = "media_files", "recordings", "run_log", "recording_metrics", "mask_px"
NAMES = r"""
f AS (SELECT path, regexp_extract(path, '\.([^./]*)$', 1) AS ext, regexp_replace(path, '\.[^./]*$', '') AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS dir FROM media_files),
n AS (SELECT *, regexp_extract(stem, '([^/]*)$', 1) AS name FROM f)
"""


@query("scan_recordings", FILES, ctes=NAMES, sql="SELECT coalesce(nullif(dir, ''), 'root') AS grp, name, path FROM n WHERE lower(ext) IN ('mp4', 'avi', 'mov', 'tif', 'tiff')")
def scan_recordings(files):
    return R.recordings_of(files)


@query("read_sidecars", REC, sql="SELECT recording_id, grp, name, coalesce(um_per_px, 1.0::DOUBLE) AS um_per_px, coalesce(time_interval_min, 1.0::DOUBLE) AS time_interval_min FROM recordings")
def read_sidecars(rec):
    return R.with_defaults(rec)


def with_sidecars(scanned, rec):
    """Recordings with the sidecar that their name's number tells: one of a stem, however many files share it."""
    stems = scanned.select(R.stem(F.col("path")).alias("stem"), F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("k")).distinct()
    return R.build_recordings(scanned, stems.join(rec.withColumn("k", F.col("recording_id")), "k").select("stem", "name", "um_per_px", "time_interval_min"))


@query("build_recordings", FILES, REC, ctes=NAMES, sql="""SELECT coalesce(nullif(dir, ''), 'root') AS grp, coalesce(r.name, n.name) AS name, path, coalesce(um_per_px, 1.0::DOUBLE) AS um_per_px, coalesce(time_interval_min, 1.0::DOUBLE) AS time_interval_min
FROM n LEFT JOIN recordings r ON r.recording_id = regexp_extract(n.name, '(\\d+)', 1)::BIGINT WHERE lower(ext) IN ('mp4', 'tif')""".replace("\\\\d", "\\d"))
def build_recordings(files, rec):
    return with_sidecars(R.recordings_of(files), rec)


@query("scale_override", REC, sql="SELECT recording_id, grp, name, 0.5::DOUBLE AS um_per_px, time_interval_min FROM recordings")
def scale_override(rec):
    return R.scale_override(rec, 0.5, 0.0)


@query("index_mask_files", FILES, ctes=NAMES, sql="SELECT path, CASE WHEN contains(path, 'masks') AND len(d) > 1 THEN d[-2] ELSE d[-1] END::INT AS frame FROM (SELECT path, regexp_extract_all(name, '\\d+') AS d FROM n) x WHERE len(d) > 0".replace("\\\\d", "\\d"))
def index_mask_files(files):
    return R.index_mask_files(files)


PAIR_NAMES = NAMES.replace("FROM media_files", "FROM (SELECT path FROM media_files UNION ALL SELECT replace(path, '_masks', '') FROM media_files WHERE contains(path, '_masks')) x")


@query("pair_training_files", FILES, ctes=PAIR_NAMES, sql=r"""SELECT i.path AS image, m.mask FROM (SELECT path, stem FROM n WHERE NOT regexp_matches(name, '_masks?$')) i
JOIN (SELECT regexp_replace(stem, '_masks?$', '') AS b, min(path) AS mask FROM n WHERE regexp_matches(name, '_masks?$') GROUP BY 1) m ON i.stem = m.b
UNION ALL SELECT i.path, m.mask FROM (SELECT path, regexp_extract(name, '(\d+)\D*$', 1) AS k FROM n WHERE NOT regexp_matches(name, '_masks?$')) i
JOIN (SELECT regexp_extract(name, '(\d+)\D*$', 1) AS k, min(path) AS mask FROM n WHERE regexp_matches(name, '_masks?$') GROUP BY 1) m ON i.k = m.k AND m.k <> ''
WHERE NOT EXISTS (SELECT 1 FROM n a JOIN n b ON a.stem = regexp_replace(b.stem, '_masks?$', '') WHERE NOT regexp_matches(a.name, '_masks?$') AND regexp_matches(b.name, '_masks?$'))""")
def pair_training_files(files):
    images = files.where(F.contains("path", F.lit("_masks"))).select(F.replace("path", F.lit("_masks"), F.lit("")).alias("path"))
    return R.pair_training_files(files.unionByName(images))


@query("read_masks", PX, sql="SELECT recording_id, frame, label, row_, col_ FROM mask_px WHERE label > 0")
def read_masks(px):
    return R.read_masks(px)


METRIC_SCHEMA = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("motion", T.StructType([T.StructField("mean_speed", T.DoubleType())])), T.StructField("shape", T.StructType([T.StructField("mean_area", T.DoubleType()), T.StructField("n_cells", T.DoubleType())]))])
def json_fields(*columns: str) -> str:
    """SQL text of the JSON fields of columns; missing values are left out, texts quoted."""
    value = lambda c: f"'\"' || {c} || '\"'" if c in ("grp", "cohort") else f"{c}::VARCHAR"
    return "concat_ws(',', " + ", ".join(f"'\"{c}\":' || {value(c)}" for c in columns) + ")"


NESTED = {"motion": ["mean_speed"], "shape": ["mean_area", "n_cells"]}


@query("metrics_json", RM, sql=f"""SELECT recording_id, '{{' || {json_fields("recording_id", "grp", "cohort")} || ',"motion":{{' || {json_fields("mean_speed")} || '}},"shape":{{' || {json_fields("mean_area", "n_cells")} || '}}}}' AS document FROM recording_metrics""")
def metrics_json(rm):
    return K.metrics_documents(rm, ["recording_id"], NESTED)


@query("read_metrics", RM, sql="""SELECT recording_id, label, value FROM (SELECT recording_id, 'recording_id' AS label, recording_id::DOUBLE AS value FROM recording_metrics UNION ALL
SELECT recording_id, 'motion.mean_speed', mean_speed::DOUBLE FROM recording_metrics UNION ALL SELECT recording_id, 'shape.mean_area', mean_area FROM recording_metrics UNION ALL SELECT recording_id, 'shape.n_cells', n_cells FROM recording_metrics) x WHERE value IS NOT NULL""")
def read_metrics(rm):
    docs = K.metrics_documents(rm, ["recording_id"], NESTED)
    return R.read_metrics(docs, METRIC_SCHEMA).select("recording_id", "label", "value")


@query("export_metrics_subset", RM, sql=f"""SELECT recording_id, '{{' || {json_fields("recording_id", "mean_speed", "n_cells")} || '}}' AS document FROM recording_metrics""")
def export_metrics_subset(rm):
    return K.export_metrics_subset(rm, ["mean_speed", "n_cells", "absent"], ["recording_id"])


@query("batch_summary_csv", RM, sql="SELECT grp AS \"group\", recording_id::VARCHAR AS name, mean_speed::DOUBLE AS mean_speed_um_min, '?' AS refinement_chosen FROM recording_metrics")
def batch_summary_csv(rm):
    rows = rm.select(F.col("grp").alias("group"), F.col("recording_id").cast("string").alias("name"), F.col("mean_speed").cast("double").alias("mean_speed_um_min"))
    path = f"{shared_dir(rm.sparkSession)}/summary-{uuid.uuid4().hex}"
    K.batch_summary_csv(rows, path)
    return rm.sparkSession.read.schema(K.recording_metrics(rows).schema).option("header", True).csv(path).select("group", "name", "mean_speed_um_min", "refinement_chosen")


@query("project_record", RM, sql=f"""SELECT recording_id, '{{"version":1,"state":{{' || {json_fields("recording_id", "grp", "cohort", "mean_speed", "mean_area", "n_cells")} || '}},"masks":"/masks/recording_id=' || recording_id || '"}}' AS document FROM recording_metrics""")
def project_record(rm):
    return K.project_records(rm, "/masks")


@query("params_record", RM, sql="""SELECT recording_id, 100 + recording_id % 7 AS min_area_px, 150.0::DOUBLE AS max_hop_px, 72 AS n_sectors, TRUE AS refine FROM recording_metrics""")
def params_record(rm):
    rows = rm.select("recording_id", F.to_json(F.struct((100 + F.col("recording_id") % 7).alias("min_area_px"))).alias("params"))
    out = R.params_record(rows)
    return out.select("recording_id", F.col("record.min_area_px").cast("long").alias("min_area_px"), "record.max_hop_px", "record.n_sectors", "record.refine")


@query("run_log_sink", LOG, sql="SELECT kind, ts, concat('- **', strftime(ts, '%Y-%m-%d %H:%M:%S'), '** ', message) AS line FROM run_log")
def run_log_sink(log):
    path = f"{shared_dir(log.sparkSession)}/log-{uuid.uuid4().hex}"
    K.append_log(log, path)
    return K.log_markdown(R.read_log(log.sparkSession, path, log.schema))


@query("latest_log", LOG, sql="SELECT ts, kind, message, details FROM run_log QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, message) = 1")
def latest_log(log):
    return R.latest_log(log)


@query("convex_solidity", PX, ctes=SHAPES.replace("{src}", "mask_px"), sql="SELECT recording_id, frame, label, round(n / convex, 6) AS solidity FROM sides JOIN convex USING (recording_id, frame, label)")
def convex_solidity(px):
    return rounded(O.solidity(px), "solidity")


@query("per_object_apply", PX, sql="SELECT recording_id, frame, label, min(row_) - 2 AS r0, min(col_) - 2 AS c0, count(*) AS kept FROM mask_px GROUP BY ALL")
def per_object_apply(px):
    same = O.per_object_apply(px, lambda crop: crop, pad=2)
    return same.groupBy(*M.OBJECT).agg((F.min("row_") - 2).alias("r0"), (F.min("col_") - 2).alias("c0"), F.count("*").alias("kept"))


EMPTY = [c for c in K.SCALAR_COLUMNS if c not in ("group", "name", "n_frames", "mean_speed_um_min", "total_distance_um", "net_displacement_um", "persistence", "refinement_chosen")]


@query("recording_metrics", "track_points", ctes=STEPS, sql="""SELECT recording_id AS "group", track_id::VARCHAR AS name, n_frames, round(mean_speed, 6) AS mean_speed_um_min, round(total, 6) AS total_distance_um,
  round(net, 6) AS net_displacement_um, round(net / nullif(total, 0), 6) AS persistence, '?' AS refinement_chosen, """ + ", ".join(f"NULL::DOUBLE AS {c}" for c in EMPTY) + " FROM tracked")
def recording_metrics(points):
    t = tracks.analyze_recording(points)
    rows = t.select(F.col("recording_id").alias("group"), F.col("track_id").cast("string").alias("name"), "n_frames", F.col("mean_speed").alias("mean_speed_um_min"),
                    F.col("total_distance").alias("total_distance_um"), F.col("net_displacement").alias("net_displacement_um"), "persistence")
    return rounded(K.recording_metrics(rows), "mean_speed_um_min", "total_distance_um", "net_displacement_um", "persistence")


@query("group_summary_csv", RM, sql="""SELECT grp, count(*) AS n, round(avg(mean_area), 6) AS mean_area_mean, round(stddev_samp(mean_area), 6) AS mean_area_std, round(stddev_samp(mean_area) / sqrt(count(*)), 6) AS mean_area_sem
FROM recording_metrics GROUP BY grp""")
def group_summary_csv(rm):
    path = f"{shared_dir(rm.sparkSession)}/csv-{uuid.uuid4().hex}"
    K.group_summary_csv(rm.select("recording_id", "grp", "mean_area"), "grp", ["mean_area"], path)
    back = rm.sparkSession.read.schema("grp string, n long, mean_area_mean double, mean_area_std double, mean_area_sem double").option("header", True).csv(f"{path}/groups")
    return rounded(back, "mean_area_mean", "mean_area_std", "mean_area_sem")


@query("per_cell_shapes_csv", PX, ctes=BIG + "," + SHAPES.replace("{src}", "big") + """,
mid AS (SELECT recording_id, frame, avg(row_) AS cy, avg(col_) AS cx FROM big GROUP BY ALL),
walk AS (SELECT recording_id, frame, cy, cx, sqrt(pow(lead(cy) OVER w - cy, 2) + pow(lead(cx) OVER w - cx, 2)) * 0.65::DOUBLE / 5 AS speed FROM spine LEFT JOIN mid USING (recording_id, frame) WINDOW w AS (PARTITION BY recording_id ORDER BY frame))
""", sql="SELECT recording_id, frame, " + ", ".join(f"round({c}, 5) AS {n}" for n, c in zip(assembled.CELL_COLUMNS, ["cy", "cx", *DESCR, "speed"])) + " FROM walk LEFT JOIN shapes USING (recording_id, frame)")
def per_cell_shapes_csv(px):
    path = f"{shared_dir(px.sparkSession)}/cells-{uuid.uuid4().hex}"
    K.per_cell_csv(assembled.per_cell_table(px), path)
    back = px.sparkSession.read.schema("frame int, " + ", ".join(f"{c} double" for c in assembled.CELL_COLUMNS) + ", recording_id string").option("header", True).csv(path)
    return rounded(back.select("recording_id", "frame", *assembled.CELL_COLUMNS), *assembled.CELL_COLUMNS, n=5)


@query("detection_checkpoint", PX, sql="SELECT recording_id, frame, label, row_, col_, 'primary' AS provenance, 2 AS version, 'detection' AS kind FROM mask_px")
def detection_checkpoint(px):
    path = f"{shared_dir(px.sparkSession)}/detection-{uuid.uuid4().hex}"
    K.save_detection(px, path)
    return R.load_detection(px.sparkSession, path).select("recording_id", "frame", "label", "row_", "col_", "provenance", "version", "kind")


def stream_tracker(spark, sf_dir):
    return S.replay_tracker(view(spark, sf_dir, "detections"))


def stream_gap_sessions(spark, sf_dir):
    return S.replay_gap_sessions(view(spark, sf_dir, "detections"))


QUERIES["stream_tracker"] = stream_tracker
QUERIES["stream_gap_sessions"] = stream_gap_sessions
ORACLE_SQL["stream_gap_sessions"] = "SELECT recording_id, label, first_frame, last_frame, n FROM (" + ORACLE_SQL["gap_sessions"] + ") x"

#: Pixels of at least 128 as masks of one object a frame.
SEEDS = duckdb_with("pixels") + ",\nmask_px AS MATERIALIZED (SELECT recording_id, frame, 1 AS label, row_, col_ FROM pixels WHERE intensity >= 128)"
FIGURES = ["mean_speed_um_min", "total_distance_um", "net_displacement_um", "persistence", "mean_area_um2", "area_cv", "mean_consec_iou", "mean_boundary_confidence", *assembled.EDGE_NAMES.values()]


def seeded(name: str) -> str:
    """The SQL of a query over masks, over SEEDS instead; its figures keep 12 digits, to be rounded once."""
    return "(" + re.sub(r", [456]\) AS", ", 12) AS", ORACLE_SQL[name].replace(duckdb_with("mask_px"), SEEDS)) + ")"


def analyze_masks(spark, sf_dir):
    px = view(spark, sf_dir, "pixels")
    rows = assembled.analyze_masks(P.seed_mask(px), px)
    named = K.recording_metrics(rows.withColumn("group", F.lit("all")).withColumn("name", F.col("recording_id").cast("string")))
    return rounded(named, *FIGURES, n=4)


QUERIES["analyze_masks"] = analyze_masks
ORACLE_SQL["analyze_masks"] = SEEDS + """,
path AS (SELECT *, lead(frame) OVER w AS nf, sqrt(pow(lead(cy) OVER w - cy, 2) + pow(lead(cx) OVER w - cx, 2)) * 0.65::DOUBLE AS step FROM (
  SELECT s.recording_id, s.frame, avg(row_) AS cy, avg(col_) AS cx FROM (SELECT recording_id, unnest(range(0, m + 1))::INT AS frame FROM (SELECT recording_id, max(frame) AS m FROM mask_px GROUP BY ALL) q) s
  LEFT JOIN mask_px USING (recording_id, frame) GROUP BY ALL) x WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
moved AS (SELECT recording_id, count(*) AS n_frames, avg(step) / 5.0::DOUBLE AS speed, coalesce(sum(step), 0) AS total,
  CASE WHEN count(cy) >= 2 THEN 0.65::DOUBLE * sqrt(pow(arg_max(cy, frame) - arg_min(cy, frame), 2) + pow(arg_max(cx, frame) - arg_min(cx, frame), 2)) END AS net FROM path GROUP BY ALL)
SELECT 'all' AS "group", recording_id::VARCHAR AS name, n_frames, round(speed, 4) AS mean_speed_um_min, round(total, 4) AS total_distance_um, round(net, 4) AS net_displacement_um, round(CASE WHEN total > 0 THEN net / total END, 4) AS persistence,
  round(mean_area_um2, 4) AS mean_area_um2, round(area_cv, 4) AS area_cv, n_large_jumps, round(mean_consec_iou, 4) AS mean_consec_iou, round(confidence, 4) AS mean_boundary_confidence,
  """ + ", ".join(f"round({a}, 4) AS {b}" for a, b in assembled.EDGE_NAMES.items()) + """, '?' AS refinement_chosen
FROM moved LEFT JOIN """ + seeded("area_stability") + " a USING (recording_id) LEFT JOIN " + seeded("edge_summary") + """ e USING (recording_id)
LEFT JOIN (SELECT recording_id, avg(confidence) AS confidence FROM """ + seeded("boundary_confidence") + " b GROUP BY ALL) c USING (recording_id)"
