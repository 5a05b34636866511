"""Queries of the linking and cascade operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import cascade as C
from strandline.operators import linking as L
from strandline.operators import masks as M
from strandline.plans.q_tracks import rounded
from strandline.plans.registry import query

DET, TP, LIVES, SRC, CONF, PX = "detections", "track_points", "track_lives", "source_masks", "config_scores", "mask_px"
CAND = """
cand AS (SELECT a.recording_id, a.frame, a.label, b.frame AS frame2, b.label AS label2, b.frame - a.frame AS gap, sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx)) AS dist
  FROM detections a JOIN detections b ON a.recording_id = b.recording_id AND b.frame > a.frame AND b.frame - a.frame <= 11
  WHERE sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx)) <= 20 * (b.frame - a.frame))
"""
MUTUAL = CAND + """,
mutual AS (SELECT recording_id, frame, label, frame2, label2, dist FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame, label ORDER BY dist, label2) AS o,
  row_number() OVER (PARTITION BY recording_id, frame2, label2 ORDER BY dist, label) AS b FROM cand WHERE gap = 1) x WHERE o = 1 AND b = 1)
"""


@query("link_candidates", DET, ctes=CAND, sql="SELECT recording_id, frame, label, frame2, label2, gap, round(dist, 6) AS dist FROM cand")
def link_candidates(d):
    return rounded(L.link_candidates(d), "dist")


@query("link_mutual_nearest", DET, ctes=MUTUAL, sql="SELECT recording_id, frame, label, frame2, label2, round(dist, 6) AS dist FROM mutual")
def link_mutual_nearest(d):
    return rounded(L.link_mutual_nearest(d), "dist")


@query("tracks_from_links", DET, ctes=MUTUAL + """,
chain AS MATERIALIZED (WITH RECURSIVE r(recording_id, frame, label, f0, l0) AS (
  SELECT d.recording_id, d.frame, d.label, d.frame, d.label FROM detections d ANTI JOIN (SELECT recording_id, frame2 AS frame, label2 AS label FROM mutual) m USING (recording_id, frame, label)
  UNION ALL SELECT m.recording_id, m.frame2, m.label2, r.f0, r.l0 FROM r JOIN mutual m USING (recording_id, frame, label)) SELECT * FROM r)
""", sql="SELECT recording_id, (dense_rank() OVER (PARTITION BY recording_id ORDER BY f0, l0) - 1)::INT AS track_id, frame, label FROM chain")
def tracks_from_links(d):
    return L.tracks_from_links(d, L.link_mutual_nearest(d)).select("recording_id", "track_id", "frame", "label")


@query("track_assign", DET)
def track_assign(d):
    return L.track_assign(d)


@query("anchor_single", DET, ctes="""
fr AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY frame) AS n FROM detections),
walk AS MATERIALIZED (WITH RECURSIVE r(recording_id, n, label, y, x) AS (
  SELECT recording_id, n, arg_max(label, (area_px, -label)), arg_max(cy, (area_px, -label)), arg_max(cx, (area_px, -label)) FROM fr WHERE n = 1 GROUP BY recording_id, n
  UNION ALL SELECT recording_id, n, near.label, coalesce(near.cy, y), coalesce(near.cx, x) FROM (
    SELECT r.recording_id, fr.n, y, x, arg_min({'label': fr.label, 'cy': cy, 'cx': cx}, (sqrt(pow(cy - y, 2) + pow(cx - x, 2)), fr.label)) FILTER (sqrt(pow(cy - y, 2) + pow(cx - x, 2)) <= 80) AS near
    FROM r JOIN fr ON fr.recording_id = r.recording_id AND fr.n = r.n + 1 GROUP BY r.recording_id, fr.n, y, x) q) SELECT * FROM r)
""", sql="SELECT recording_id, frame, label, cy, cx, area_px FROM fr JOIN walk USING (recording_id, n, label)")
def anchor_single(d):
    return L.anchor_single(d)


@query("min_track_length", TP, sql="SELECT p.* FROM track_points p SEMI JOIN (SELECT recording_id, track_id FROM track_points WHERE cy IS NOT NULL GROUP BY ALL HAVING count(DISTINCT frame) >= 12) k USING (recording_id, track_id)")
def min_track_length(p):
    return L.min_track_length(p, 12)


@query("division_lineage", LIVES, sql="""SELECT recording_id, track_id, division_frame, min(parent_id) AS parent_id, round(arg_min(ratio, parent_id), 6) AS area_ratio FROM (
  SELECT c.recording_id, c.track_id, c.first_frame AS division_frame, p.track_id AS parent_id, c.first_area::DOUBLE / p.last_area AS ratio
  FROM track_lives c JOIN track_lives p ON c.recording_id = p.recording_id AND p.track_id <> c.track_id AND (p.last_frame = c.first_frame OR p.last_frame = c.first_frame - 1)
  WHERE c.first_frame > 0 AND sqrt(pow(c.first_cy - p.last_cy, 2) + pow(c.first_cx - p.last_cx, 2)) <= 150 AND c.first_area::DOUBLE / p.last_area BETWEEN 0.2 AND 0.9) x GROUP BY recording_id, track_id, division_frame""")
def division_lineage(lives):
    return rounded(L.division_lineage(lives), "area_ratio")


GAPS = """
life AS (SELECT recording_id, track_id, min(frame) AS a, max(frame) AS b FROM track_points WHERE cy IS NOT NULL GROUP BY ALL),
gaps AS (SELECT p.recording_id, p.track_id, p.frame FROM track_points p JOIN life USING (recording_id, track_id) WHERE p.cy IS NULL AND frame > a AND frame < b),
flank AS (SELECT *, max(CASE WHEN cy IS NOT NULL THEN frame END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f0,
  min(CASE WHEN cy IS NOT NULL THEN frame END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM track_points WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame)),
inter AS (SELECT f.recording_id, f.track_id, f.frame,
  CASE WHEN f0 IS NULL THEN q.cy WHEN f1 IS NULL THEN p.cy ELSE p.cy + (q.cy - p.cy) * ((f.frame - f0)::DOUBLE / (f1 - f0)) END AS cy,
  CASE WHEN f0 IS NULL THEN q.cx WHEN f1 IS NULL THEN p.cx ELSE p.cx + (q.cx - p.cx) * ((f.frame - f0)::DOUBLE / (f1 - f0)) END AS cx
  FROM flank f LEFT JOIN track_points p ON p.recording_id = f.recording_id AND p.track_id = f.track_id AND p.frame = f0
  LEFT JOIN track_points q ON q.recording_id = f.recording_id AND q.track_id = f.track_id AND q.frame = f1 WHERE f.cy IS NULL),
near AS (SELECT i.recording_id, i.track_id, i.frame, d.label, d.cy, d.cx, d.area_px, sqrt(pow(i.cy - d.cy, 2) + pow(i.cx - d.cx, 2)) AS dist
  FROM inter i JOIN detections d ON d.recording_id = i.recording_id AND d.frame = i.frame WHERE sqrt(pow(i.cy - d.cy, 2) + pow(i.cx - d.cx, 2)) < 60
  QUALIFY row_number() OVER (PARTITION BY i.recording_id, i.track_id, i.frame ORDER BY sqrt(pow(i.cy - d.cy, 2) + pow(i.cx - d.cx, 2)), d.label) = 1)
"""


@query("track_gaps", TP, ctes=GAPS.split(",\nflank")[0], sql="SELECT * FROM gaps")
def track_gaps(p):
    return L.track_gaps(p)


@query("interpolate_centroid", TP, ctes=GAPS.split(",\nnear")[0], sql="SELECT recording_id, track_id, frame, round(cy, 6) AS cy, round(cx, 6) AS cx FROM inter")
def interpolate_centroid(p):
    return rounded(L.interpolate_centroid(p), "cy", "cx")


@query("nearest_detection", TP, DET, ctes=GAPS, sql="SELECT recording_id, track_id, frame, label, round(cy, 6) AS cy, round(cx, 6) AS cx, area_px, round(dist, 6) AS dist FROM near")
def nearest_detection(p, d):
    return rounded(L.nearest_detection(L.interpolate_centroid(p), d, 60.0), "cy", "cx", "dist")


@query("fill_track_gaps", TP, DET, ctes=GAPS, sql="""SELECT p.recording_id, p.track_id, p.frame, round(coalesce(p.cy, n.cy), 6) AS cy, round(coalesce(p.cx, n.cx), 6) AS cx, n.cy IS NOT NULL AS is_filled
FROM track_points p LEFT JOIN (SELECT near.* FROM near SEMI JOIN gaps USING (recording_id, track_id, frame)) n USING (recording_id, track_id, frame)""")
def fill_track_gaps(p, d):
    return rounded(L.fill_track_gaps(p, d, 60.0), "cy", "cx")


@query("attach_labels", PX, ctes="pts AS (SELECT recording_id, frame, min(row_)::DOUBLE + 0.25::DOUBLE AS cy, min(col_)::DOUBLE + 1.25::DOUBLE AS cx FROM mask_px GROUP BY ALL)", sql="""SELECT p.recording_id, p.frame, p.cy, p.cx, m.label
FROM pts p LEFT JOIN (SELECT recording_id, frame, row_, col_, min(label) AS label FROM mask_px GROUP BY ALL) m ON m.recording_id = p.recording_id AND m.frame = p.frame AND m.row_ = round(p.cy)::INT AND m.col_ = round(p.cx)::INT""")
def attach_labels(px):
    pts = px.groupBy(*M.FRAME).agg((F.min("row_") + 0.25).cast("double").alias("cy"), (F.min("col_") + 1.25).cast("double").alias("cx"))
    return L.attach_labels(pts, px)


@query("import_track_masks", PX, sql="""SELECT recording_id, track_id, frame, round(cy, 6) AS cy, round(cx, 6) AS cx, area_px, first_frame FROM (
  SELECT *, min(frame) OVER (PARTITION BY recording_id, track_id) AS first_frame, max(area_px) OVER (PARTITION BY recording_id, track_id) AS m
  FROM (SELECT recording_id, label AS track_id, frame, avg(row_) AS cy, avg(col_) AS cx, count(*) AS area_px FROM mask_px GROUP BY ALL) x) y WHERE m >= 60""")
def import_track_masks(px):
    return rounded(L.import_track_masks(px), "cy", "cx")


@query("gap_sessions", "detections", sql="""SELECT recording_id, label, session, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id, label ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM (
    SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY recording_id, label ORDER BY frame) > 11 THEN 1 ELSE 0 END AS brk FROM detections) x) y GROUP BY ALL""")
def gap_sessions(d):
    return L.gap_sessions(d, ["recording_id", "label"])


@query("top_n_objects", DET, sql="SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY area_px DESC, label) <= 3")
def top_n_objects(d):
    return M.top_n_objects(d, 3)


@query("cell_counts", DET, sql="""SELECT recording_id, min(n) AS min_cells, max(n) AS max_cells, round(avg(n), 6) AS mean_cells FROM (SELECT recording_id, frame, count(DISTINCT label) AS n FROM detections GROUP BY ALL) x GROUP BY ALL""")
def cell_counts(d):
    return rounded(M.cell_counts(d), "mean_cells")


SAMPLE = """
nk AS (SELECT recording_id, max(frame) + 1 AS n, least(max(frame) + 1, 50) AS k FROM detections GROUP BY ALL),
sampled AS (SELECT DISTINCT recording_id, CASE WHEN k > 1 THEN floor(i * (n - 1) / (k - 1)::DOUBLE) ELSE 0 END::INT AS frame FROM (SELECT *, unnest(range(0, k)) AS i FROM nk) x)
"""


@query("sample_frames", DET, ctes=SAMPLE, sql="SELECT * FROM sampled")
def sample_frames(d):
    return M.sample_frames(d, 50)


@query("scan_cell_count", DET, ctes=SAMPLE, sql="SELECT recording_id, max(c) AS max_cells FROM (SELECT recording_id, frame, count(*) AS c FROM detections SEMI JOIN sampled USING (recording_id, frame) WHERE area_px >= 500 GROUP BY ALL) x GROUP BY ALL")
def scan_cell_count(d):
    return M.scan_cell_count(d, 50)


CHOSEN = """
chosen AS (SELECT frame, coalesce(arg_min(source, priority) FILTER (area_px >= 400), 'failed') AS provenance, arg_min(area_px, priority) FILTER (area_px >= 400) AS area_px FROM source_masks GROUP BY frame)
"""


@query("first_valid_source", SRC, ctes=CHOSEN, sql="SELECT * FROM chosen")
def first_valid_source(m):
    return C.first_valid_source(m)


@query("failed_frames", SRC, sql="SELECT unnest(range(a, b + 1)) AS frame FROM (SELECT min(frame) AS a, max(frame) AS b FROM source_masks) x EXCEPT SELECT frame FROM source_masks WHERE area_px >= 400")
def failed_frames(m):
    return C.failed_frames(m)


@query("provenance_stats", SRC, ctes=CHOSEN, sql="SELECT provenance, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM chosen GROUP BY provenance")
def provenance_stats(m):
    return rounded(C.provenance_stats(C.first_valid_source(m)), "share")


@query("flanking_frames", SRC, ctes=CHOSEN, sql="""SELECT frame, before, after, round((frame - before)::DOUBLE / (after - before), 6) AS alpha,
  CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN 'both' WHEN before IS NOT NULL THEN 'forward' WHEN after IS NOT NULL THEN 'backward' ELSE 'none' END AS mode
FROM (SELECT *, max(CASE WHEN provenance <> 'failed' THEN frame END) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  min(CASE WHEN provenance <> 'failed' THEN frame END) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM chosen) x WHERE provenance = 'failed'""")
def flanking_frames(m):
    return rounded(C.flanking_frames(C.first_valid_source(m)), "alpha")


@query("skip_by_provenance", SRC, ctes=CHOSEN, sql="SELECT frame, source, priority, CASE WHEN frame IN (SELECT frame FROM chosen WHERE provenance = 'N') THEN area_px ELSE area_px * 2 END AS area_px FROM source_masks")
def skip_by_provenance(m):
    return C.skip_by_provenance(m, m.withColumn("area_px", F.col("area_px") * 2), C.first_valid_source(m), ["N"])


@query("config_select", CONF, sql="""SELECT recording_id, config_id, search, round(score, 6) AS score FROM (
  SELECT *, max(score) OVER (PARTITION BY recording_id) AS best FROM (
    SELECT *, CASE WHEN config_id = bid THEN quality WHEN iou < 0.55::DOUBLE THEN 0 WHEN greatest(0, biou - iou) <= 0.05::DOUBLE THEN quality WHEN greatest(0, biou - iou) >= 0.2::DOUBLE THEN 0
      ELSE quality * (1 - (biou - iou - 0.05::DOUBLE) / (0.2::DOUBLE - 0.05::DOUBLE)) END AS score
    FROM (SELECT *, min(config_id) OVER (PARTITION BY recording_id) AS bid, first_value(iou) OVER (PARTITION BY recording_id ORDER BY config_id) AS biou FROM config_scores) a) b) c
WHERE score >= 0.85::DOUBLE * best QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY search, score DESC, config_id) = 1""")
def config_select(s):
    return rounded(C.config_select(s), "score")


@query("config_select_floor", CONF, sql="""SELECT recording_id, CASE WHEN q > bq THEN id ELSE bid END AS config_id, CASE WHEN q > bq THEN q ELSE bq END AS quality FROM (
  SELECT recording_id, min(config_id) AS bid, arg_min(quality, config_id) AS bq, max(CASE WHEN iou < 0.4::DOUBLE THEN 0 ELSE quality END) AS q,
    arg_max(config_id, (CASE WHEN iou < 0.4::DOUBLE THEN 0 ELSE quality END, -config_id)) AS id FROM config_scores GROUP BY ALL) x""")
def config_select_floor(s):
    return C.config_select_floor(s)
