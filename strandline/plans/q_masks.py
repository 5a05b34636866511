"""Queries of the mask and edge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.primitives import frame_spine
from strandline.operators import edges as E
from strandline.operators import masks as M
from strandline.operators import quality as Q
from strandline.operators import summaries
from strandline.plans.q_tracks import rounded
from strandline.plans.registry import query

PX = "mask_px"
BIG = """
objs AS (SELECT recording_id, frame, label, avg(row_) AS cy, avg(col_) AS cx, count(*) AS area_px FROM mask_px GROUP BY ALL),
big AS (SELECT * FROM mask_px SEMI JOIN (SELECT recording_id, frame, label FROM objs QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY area_px DESC, label) = 1) b USING (recording_id, frame, label)),
spine AS (SELECT recording_id, unnest(range(0, m + 1))::INT AS frame FROM (SELECT recording_id, max(frame) AS m FROM mask_px GROUP BY ALL) x)
"""
RUNS = """
px AS (SELECT DISTINCT recording_id, frame, row_, col_ FROM mask_px),
runs AS (SELECT row_number() OVER (ORDER BY recording_id, frame, row_, c0) AS id, * FROM (
  SELECT recording_id, frame, row_, min(col_) AS c0, max(col_) AS c1 FROM (
    SELECT *, col_ - row_number() OVER (PARTITION BY recording_id, frame, row_ ORDER BY col_) AS k FROM px) x GROUP BY recording_id, frame, row_, k) y),
"""
COMPONENTS = RUNS + """
touch AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.recording_id = b.recording_id AND a.frame = b.frame AND b.row_ = a.row_ + 1 AND b.c0 <= a.c1 + 1 AND b.c1 >= a.c0 - 1),
both_ways AS (SELECT a, b FROM touch UNION SELECT b, a FROM touch UNION SELECT id, id FROM runs),
reach AS MATERIALIZED (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a) SELECT a, min(b) AS root FROM r GROUP BY a),
named AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id, frame ORDER BY root)::INT AS label FROM runs JOIN reach ON id = a)
"""
SHAPES = """
bnd AS (SELECT DISTINCT p.recording_id, p.frame, p.label, p.row_, p.col_ FROM (SELECT p.*, a, b FROM {src} p CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b)) p
  LEFT JOIN {src} q ON q.recording_id = p.recording_id AND q.frame = p.frame AND q.label = p.label AND q.row_ = p.row_ + a AND q.col_ = p.col_ + b WHERE q.label IS NULL),
cells AS (SELECT recording_id, frame, label, row_ + a AS r, col_ + b AS c, sum(k)::INT AS m FROM bnd CROSS JOIN (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)) t(a, b, k) GROUP BY ALL),
chain AS (SELECT recording_id, frame, label, sum((CASE WHEN m & 3 = 3 THEN 0.5 ELSE 0 END + CASE WHEN m & 12 = 12 THEN 0.5 ELSE 0 END + CASE WHEN m & 5 = 5 THEN 0.5 ELSE 0 END
  + CASE WHEN m & 10 = 10 THEN 0.5 ELSE 0 END)::DOUBLE + CASE WHEN m IN (6, 9) THEN sqrt(2.0::DOUBLE) ELSE 0 END) AS len FROM cells GROUP BY ALL),
sides AS (
  SELECT recording_id, frame, label, count(*) AS n, max(col_) - min(col_) + 1 AS w, max(row_) - min(row_) + 1 AS ht,
         var_pop(row_) + 1.0::DOUBLE / 12 AS vr, var_pop(col_) + 1.0::DOUBLE / 12 AS vc, covar_pop(row_, col_) AS cov FROM {src} GROUP BY ALL),
ends AS (SELECT recording_id, frame, label, row_, min(col_) AS a, max(col_) AS b FROM {src} GROUP BY ALL),
mids AS (SELECT recording_id, frame, label, y, min(lo) AS lo, max(hi) AS hi FROM (SELECT recording_id, frame, label, 2 * row_ AS y, 2 * a - 1 AS lo, 2 * b + 1 AS hi FROM ends
  UNION ALL SELECT recording_id, frame, label, 2 * row_ - 1, 2 * a, 2 * b FROM ends UNION ALL SELECT recording_id, frame, label, 2 * row_ + 1, 2 * a, 2 * b FROM ends) x GROUP BY ALL),
span AS (SELECT recording_id, frame, label, unnest(range(min(row_), max(row_) + 1)) AS r FROM ends GROUP BY recording_id, frame, label),
wide AS (SELECT s.recording_id, s.frame, s.label, r, min(i.lo + CASE WHEN j.y > i.y THEN (j.lo - i.lo)::DOUBLE * (2 * r - i.y) / (j.y - i.y) ELSE 0 END) AS lo, max(i.hi + CASE WHEN j.y > i.y THEN (j.hi - i.hi)::DOUBLE * (2 * r - i.y) / (j.y - i.y) ELSE 0 END) AS hi
  FROM span s JOIN mids i ON i.recording_id = s.recording_id AND i.frame = s.frame AND i.label = s.label AND i.y <= 2 * r JOIN mids j ON j.recording_id = s.recording_id AND j.frame = s.frame AND j.label = s.label AND j.y >= 2 * r GROUP BY ALL),
convex AS (SELECT recording_id, frame, label, sum(floor(hi / 2 + 1e-9) - ceil(lo / 2 - 1e-9) + 1) AS convex FROM wide GROUP BY ALL),
shapes AS (
  SELECT recording_id, frame, label, n * 0.4225::DOUBLE AS area_um2, len * 0.65::DOUBLE AS perimeter_um, CASE WHEN len > 0 THEN 4 * pi() * n / (len * len) END AS circularity, n / convex AS solidity, w::DOUBLE / ht AS aspect_ratio,
         sqrt(1 - ((vr + vc) / 2 - sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + cov * cov)) / ((vr + vc) / 2 + sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + cov * cov))) AS eccentricity
  FROM sides JOIN chain USING (recording_id, frame, label) JOIN convex USING (recording_id, frame, label))
"""
#: Outer boundary (bound) of the objects of {src}: gaps of rows that no chain of gaps leads out of are holes.
OUTER = """
lines AS (SELECT recording_id, frame, label, row_, min(col_) AS f0, max(col_) AS f1 FROM {src} GROUP BY ALL),
gap AS (SELECT recording_id, frame, label, row_, p + 1 AS g0, col_ - 1 AS g1 FROM (SELECT *, lag(col_) OVER (PARTITION BY recording_id, frame, label, row_ ORDER BY col_) AS p FROM {src}) x WHERE col_ - p > 1),
opened AS (SELECT g.* FROM gap g LEFT JOIN lines u ON u.recording_id = g.recording_id AND u.frame = g.frame AND u.label = g.label AND u.row_ = g.row_ - 1
  LEFT JOIN lines d ON d.recording_id = g.recording_id AND d.frame = g.frame AND d.label = g.label AND d.row_ = g.row_ + 1
  WHERE u.f0 IS NULL OR d.f0 IS NULL OR g0 < u.f0 OR g1 > u.f1 OR g0 < d.f0 OR g1 > d.f1),
outside AS MATERIALIZED (WITH RECURSIVE o AS (SELECT * FROM opened UNION SELECT g.* FROM o JOIN gap g ON g.recording_id = o.recording_id AND g.frame = o.frame AND g.label = o.label AND abs(g.row_ - o.row_) = 1 AND g.g0 <= o.g1 AND g.g1 >= o.g0) SELECT * FROM o),
hole AS (SELECT * FROM gap ANTI JOIN outside USING (recording_id, frame, label, row_, g0, g1)),
bound AS (SELECT DISTINCT p.recording_id, p.frame, p.label, p.row_, p.col_ FROM (SELECT p.*, a, b FROM {src} p CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b)) p
  LEFT JOIN {src} q ON q.recording_id = p.recording_id AND q.frame = p.frame AND q.label = p.label AND q.row_ = p.row_ + a AND q.col_ = p.col_ + b
  LEFT JOIN hole h ON h.recording_id = p.recording_id AND h.frame = p.frame AND h.label = p.label AND h.row_ = p.row_ + a AND p.col_ + b BETWEEN h.g0 AND h.g1 WHERE q.label IS NULL AND h.g0 IS NULL)
"""
DESCR = ["area_um2", "perimeter_um", "circularity", "solidity", "aspect_ratio", "eccentricity"]
DESCR_SQL = ", ".join(f"round({c}, 5) AS {c}" for c in DESCR)


@query("connected_components", PX, ctes=COMPONENTS, sql="SELECT recording_id, frame, label, count(*) AS runs, sum(c1 - c0 + 1)::BIGINT AS area_px, min(row_) AS r0, min(c0) AS c0 FROM named GROUP BY ALL")
def connected_components(px):
    runs = M.component_runs(px)
    return runs.groupBy(*M.OBJECT).agg(F.count("*").alias("runs"), F.sum(F.col("c1") - F.col("c0") + 1).alias("area_px"), F.min("row_").alias("r0"), F.min("c0").alias("c0"))


@query("largest_component", PX, ctes=BIG, sql="SELECT * FROM big")
def largest_component(px):
    return M.largest_component(px)


@query("object_table", PX, ctes=BIG, sql="SELECT recording_id, frame, label, round(cy, 6) AS cy, round(cx, 6) AS cx, area_px FROM objs WHERE area_px >= 20")
def object_table(px):
    return rounded(M.object_table(px, 20), "cy", "cx")


@query("min_area_filter", PX, ctes=BIG, sql="""SELECT p.recording_id, p.frame, n.nl AS label, p.row_, p.col_ FROM mask_px p JOIN (
  SELECT recording_id, frame, label, dense_rank() OVER (PARTITION BY recording_id, frame ORDER BY label)::INT AS nl FROM objs WHERE area_px >= 100) n USING (recording_id, frame, label)""")
def min_area_filter(px):
    return M.min_area_filter(px, 100)


@query("centroid_series", PX, ctes=BIG, sql="SELECT recording_id, frame, round(cy, 6) AS cy, round(cx, 6) AS cx FROM spine LEFT JOIN (SELECT recording_id, frame, avg(row_) AS cy, avg(col_) AS cx FROM mask_px GROUP BY ALL) c USING (recording_id, frame)")
def centroid_series(px):
    return rounded(M.centroid_series(px), "cy", "cx")


@query("object_bbox", PX, sql="""SELECT recording_id, frame, greatest(min(row_) - 5, 0) AS r0, least(max(row_) + 6, 64) AS r1, greatest(min(col_) - 5, 0) AS c0, least(max(col_) + 6, 64) AS c1
FROM mask_px GROUP BY ALL""")
def object_bbox(px):
    return M.object_bbox(px)


@query("crop_and_paste", PX, ctes="b AS (SELECT recording_id, greatest(min(row_) - 5, 0) AS r0, least(max(row_) + 6, 64) AS r1, greatest(min(col_) - 5, 0) AS c0, least(max(col_) + 6, 64) AS c1 FROM mask_px GROUP BY ALL)",
       sql="SELECT recording_id, frame, label, row_ - r0 AS row_, col_ - c0 AS col_, r0, c0 FROM mask_px JOIN b USING (recording_id) WHERE row_ >= r0 AND row_ < r1 AND col_ >= c0 AND col_ < c1")
def crop_and_paste(px):
    return M.crop(px, M.object_bbox(px, per_frame=False))


@query("boundary_pixels", PX, ctes=OUTER.replace("{src}", "mask_px"), sql="SELECT * FROM bound")
def boundary_pixels(px):
    return M.boundary_pixels(px)


@query("shape_descriptors", PX, ctes=SHAPES.replace("{src}", "mask_px"), sql=f"SELECT recording_id, frame, label, {DESCR_SQL} FROM shapes")
def shape_descriptors(px):
    return rounded(M.shape_descriptors(px), *DESCR, n=5)


@query("shape_timeseries", PX, ctes=BIG + "," + SHAPES.replace("{src}", "big"), sql=f"SELECT recording_id, frame, {DESCR_SQL} FROM spine LEFT JOIN shapes USING (recording_id, frame)")
def shape_timeseries(px):
    return rounded(M.shape_timeseries(px), *DESCR, n=5)


@query("shape_summary", PX, ctes=BIG + "," + SHAPES.replace("{src}", "big"), sql=f"""SELECT recording_id, metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max
FROM (UNPIVOT (SELECT recording_id, {", ".join(DESCR)} FROM shapes) ON {", ".join(DESCR)} INTO NAME metric VALUE value) u GROUP BY ALL""")
def shape_summary(px):
    return rounded(summaries.shape_summary(M.shape_timeseries(px), ["recording_id"], DESCR), "mean", "std", "min", "max", n=5)


IOU = """
a AS (SELECT DISTINCT recording_id, frame, row_, col_ FROM mask_px WHERE label = 1),
b AS (SELECT DISTINCT recording_id, frame, row_, col_ FROM mask_px WHERE label = 2)
"""


@query("mask_iou", PX, ctes=IOU, sql="""SELECT recording_id, frame, round(count(*) FILTER (x AND y)::DOUBLE / count(*), 6) AS iou
FROM (SELECT *, TRUE AS x FROM a) a FULL JOIN (SELECT *, TRUE AS y FROM b) b USING (recording_id, frame, row_, col_) GROUP BY ALL""")
def mask_iou(px):
    return rounded(M.mask_iou(px.where("label = 1"), px.where("label = 2")), "iou")


CONSEC = BIG + """,
p AS (SELECT DISTINCT recording_id, frame, row_, col_ FROM mask_px),
cnt AS (SELECT recording_id, frame, count(p.row_) AS n FROM spine LEFT JOIN p USING (recording_id, frame) GROUP BY ALL),
inter AS (SELECT a.recording_id, a.frame, count(*) AS bth FROM p a JOIN p b ON a.recording_id = b.recording_id AND b.frame = a.frame + 1 AND a.row_ = b.row_ AND a.col_ = b.col_ GROUP BY ALL),
consec AS (SELECT c.recording_id, c.frame, CASE WHEN c.n + d.n > 0 THEN coalesce(bth, 0)::DOUBLE / (c.n + d.n - coalesce(bth, 0)) ELSE 0 END AS iou, c.n > 0 AND d.n > 0 AS filled
  FROM cnt c JOIN cnt d ON c.recording_id = d.recording_id AND d.frame = c.frame + 1 LEFT JOIN inter i ON i.recording_id = c.recording_id AND i.frame = c.frame)
"""


@query("consecutive_iou", PX, ctes=CONSEC, sql="SELECT recording_id, frame, round(iou, 6) AS iou, filled FROM consec")
def consecutive_iou(px):
    return rounded(M.consecutive_iou(px), "iou")


@query("resolve_overlaps", PX, sql="SELECT recording_id, frame, row_, col_, min(label) AS label FROM mask_px GROUP BY ALL")
def resolve_overlaps(px):
    return M.resolve_overlaps(px)


@query("mask_union", PX, ctes=IOU, sql="SELECT * FROM (SELECT * FROM a UNION SELECT * FROM b) u SEMI JOIN a USING (recording_id, frame)")
def mask_union(px):
    return M.mask_union(px.where("label = 1"), px.where("label = 2"))


@query("mask_union_per_object", PX, sql="""SELECT recording_id, frame, row_, col_, min(label) AS label FROM (
  SELECT recording_id, frame, label, row_, col_ FROM mask_px WHERE label = 1 UNION ALL
  SELECT b.recording_id, b.frame, x.label, b.row_, b.col_ FROM mask_px b JOIN (
    SELECT recording_id, frame, label, min(row_) - 5 AS r0, max(row_) + 5 AS r1, min(col_) - 5 AS c0, max(col_) + 5 AS c1 FROM mask_px WHERE label = 1 GROUP BY ALL) x
  ON b.recording_id = x.recording_id AND b.frame = x.frame AND b.row_ BETWEEN r0 AND r1 AND b.col_ BETWEEN c0 AND c1 WHERE b.label = 2) u GROUP BY ALL""")
def mask_union_per_object(px):
    return M.mask_union_per_object(px.where("label = 1"), px.where("label = 2"), pad=5)


@query("best_overlap_component", PX, ctes="hits AS (SELECT c.recording_id, c.frame, c.label, count(*) AS overlap FROM mask_px c SEMI JOIN (SELECT * FROM mask_px WHERE label = 2) s USING (recording_id, frame, row_, col_) GROUP BY ALL)",
       sql="""SELECT recording_id, frame, label, overlap FROM (SELECT DISTINCT recording_id, frame FROM mask_px WHERE label = 2) f
LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY overlap DESC, label) = 1) h USING (recording_id, frame)""")
def best_overlap_component(px):
    return M.best_overlap_component(px, px.where("label = 2"))


TILES = "t(tile, r0, r1, c0, c1, a, b, c, d) AS (VALUES " + ", ".join(str(t) for t in M.tiles(2, 2, 64, 64, 6)) + ")"


@query("tile_assign", PX, ctes=TILES, sql="""SELECT recording_id, frame, label, row_, col_, tile, row_ >= r0 AND row_ < r1 AND col_ >= c0 AND col_ < c1 AS inner
FROM mask_px JOIN t ON row_ >= a AND row_ < b AND col_ >= c AND col_ < d""")
def tile_assign(px):
    return M.tile_assign(px, M.tiles(2, 2, 64, 64, 6))


@query("tile_merge", PX, ctes=TILES + ",\ni AS (SELECT * FROM mask_px JOIN t ON row_ >= r0 AND row_ < r1 AND col_ >= c0 AND col_ < c1)", sql="""SELECT i.recording_id, i.frame, k.nl AS label, row_, col_ FROM i JOIN (
  SELECT recording_id, frame, tile, label, dense_rank() OVER (PARTITION BY recording_id, frame ORDER BY tile, label)::INT AS nl FROM (
    SELECT recording_id, frame, tile, label FROM i GROUP BY ALL HAVING count(*) >= 20) x) k USING (recording_id, frame, tile, label)""")
def tile_merge(px):
    return M.tile_merge(M.tile_assign(px, M.tiles(2, 2, 64, 64, 6)))


@query("area_stability", PX, ctes=CONSEC + """,
areas AS (SELECT recording_id, frame, count(*) * 0.4225::DOUBLE AS area FROM p GROUP BY ALL)
""", sql="""SELECT recording_id, round(CASE WHEN n >= 2 THEN m END, 5) AS mean_area_um2, round(CASE WHEN n >= 2 THEN s / m END, 6) AS area_cv, round(CASE WHEN n >= 2 THEN hi / lo END, 6) AS max_min_ratio,
  CASE WHEN n >= 2 THEN jumps ELSE 0 END AS n_large_jumps, round(CASE WHEN n >= 2 THEN i END, 6) AS mean_consec_iou
FROM (SELECT recording_id, count(*) AS n, avg(area) AS m, stddev_pop(area) AS s, max(area) AS hi, min(area) AS lo, count(*) FILTER (abs(area - prev) / (prev + 1) > 0.3::DOUBLE) AS jumps
      FROM (SELECT *, lag(area) OVER (PARTITION BY recording_id ORDER BY frame) AS prev FROM areas) x GROUP BY ALL) y
LEFT JOIN (SELECT recording_id, avg(iou) AS i FROM consec WHERE filled GROUP BY ALL) z USING (recording_id)""")
def area_stability(px):
    return rounded(rounded(Q.area_stability(px), "mean_area_um2", n=5), "area_cv", "max_min_ratio", "mean_consec_iou")


@query("suspect_frames", PX, ctes=CONSEC, sql="""SELECT recording_id, frame, round(CASE WHEN a = 0 OR n = 0 THEN 1.0::DOUBLE ELSE abs(n - a)::DOUBLE / a END, 6) AS area_change,
  coalesce(n = 0 AND a > 0 OR n > 0 AND a > 0 AND abs(n - a)::DOUBLE / a > 0.5::DOUBLE, FALSE) AS suspect,
  CASE WHEN n = 0 AND a > 0 THEN 'lost' WHEN n > 0 AND a > 0 AND abs(n - a)::DOUBLE / a > 0.5::DOUBLE THEN concat('area ', a, ' -> ', n) END AS reason
FROM (SELECT *, lag(n) OVER (PARTITION BY recording_id ORDER BY frame) AS a FROM cnt) x WHERE a IS NOT NULL""")
def suspect_frames(px):
    return rounded(Q.suspect_frames(px), "area_change")


@query("frame_status", PX, ctes=BIG, sql="""SELECT recording_id, frame, CASE WHEN c.n IS NULL THEN 0 WHEN frame % 4 = 0 THEN 2 ELSE 1 END AS status
FROM spine LEFT JOIN (SELECT recording_id, frame, count(*) AS n FROM mask_px GROUP BY ALL) c USING (recording_id, frame)""")
def frame_status(px):
    spine = frame_spine(px, ["recording_id"])
    return M.frame_status(spine, px, spine.where("frame % 4 = 0"))


SECT = BIG + "," + OUTER.replace("{src}", "big") + """,
edge AS (SELECT DISTINCT recording_id, frame, row_, col_ FROM bound),
cen AS (SELECT recording_id, frame, avg(row_) AS cy, avg(col_) AS cx FROM big GROUP BY ALL),
polar AS (SELECT e.recording_id, e.frame, sqrt((row_ - cy) * (row_ - cy) + (col_ - cx) * (col_ - cx)) AS r,
   ((floor((atan2(row_ - cy, col_ - cx) + pi() + pi() / 72 + 1e-9) / (pi() / 36))::INT % 72) + 72) % 72 AS sector FROM edge e JOIN cen c USING (recording_id, frame)),
sect AS (SELECT recording_id, frame, sector, median(r) AS radius, count(*) AS n FROM polar GROUP BY ALL)
"""
FILL = SECT + """,
grid AS (SELECT recording_id, frame, unnest(range(0, 72))::INT AS sector FROM (SELECT DISTINCT recording_id, frame FROM sect) f),
sp AS (SELECT g.*, s.radius, count(s.radius) OVER (PARTITION BY recording_id, frame) AS k,
  last_value(CASE WHEN s.radius IS NOT NULL THEN sector END IGNORE NULLS) OVER b AS s0, last_value(s.radius IGNORE NULLS) OVER b AS r0,
  first_value(CASE WHEN s.radius IS NOT NULL THEN sector END IGNORE NULLS) OVER a AS s1, first_value(s.radius IGNORE NULLS) OVER a AS r1
  FROM grid g LEFT JOIN sect s USING (recording_id, frame, sector)
  WINDOW b AS (PARTITION BY recording_id, frame ORDER BY sector ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id, frame ORDER BY sector ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT recording_id, frame, sector, CASE WHEN radius IS NOT NULL THEN radius WHEN k <= 2 THEN NULL WHEN s0 IS NULL THEN r1 WHEN s1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * ((sector - s0)::DOUBLE / (s1 - s0)) END AS radius FROM sp)
"""


@query("polar_sectors", PX, ctes=SECT, sql="SELECT recording_id, frame, sector, round(radius, 6) AS radius, n FROM sect")
def polar_sectors(px):
    return rounded(E.polar_sectors(M.largest_component(px), 72), "radius")


@query("fill_sector_gaps", PX, ctes=FILL, sql="SELECT recording_id, frame, sector, round(radius, 6) AS radius FROM filled")
def fill_sector_gaps(px):
    return rounded(E.fill_sector_gaps(E.polar_sectors(M.largest_component(px), 72), 72), "radius")


@query("smooth_sectors", PX, ctes=FILL + ",\nk(o, w) AS (VALUES (-2, -3), (-1, 12), (0, 17), (1, 12), (2, -3))", sql="""SELECT f.recording_id, f.frame, f.sector, round(sum(g.radius * w / 35.0::DOUBLE), 6) AS radius
FROM filled f CROSS JOIN k JOIN filled g ON g.recording_id = f.recording_id AND g.frame = f.frame AND g.sector = (f.sector + o + 72) % 72 GROUP BY ALL""")
def smooth_sectors(px):
    return rounded(E.smooth_sectors(E.fill_sector_gaps(E.polar_sectors(M.largest_component(px), 72), 72), 72), "radius")


VELOCITY = SECT + """,
pr AS (SELECT c.recording_id, c.frame AS pair, (c.cy + d.cy) / 2 AS my, (c.cx + d.cx) / 2 AS mx FROM cen c JOIN cen d ON d.recording_id = c.recording_id AND d.frame = c.frame + 1),
sect2 AS (SELECT e.recording_id, p.pair, e.frame - p.pair AS side, ((floor((atan2(row_ - my, col_ - mx) + pi() + pi() / 72 + 1e-9) / (pi() / 36))::INT % 72) + 72) % 72 AS sector,
  median(sqrt((row_ - my) * (row_ - my) + (col_ - mx) * (col_ - mx))) AS radius FROM edge e JOIN pr p ON p.recording_id = e.recording_id AND (e.frame = p.pair OR e.frame = p.pair + 1) GROUP BY ALL),
grid2 AS (SELECT *, unnest(range(0, 72))::INT AS sector FROM (SELECT DISTINCT recording_id, pair, side FROM sect2) f),
sp2 AS (SELECT g.*, s.radius, count(s.radius) OVER (PARTITION BY recording_id, pair, side) AS k,
  last_value(CASE WHEN s.radius IS NOT NULL THEN sector END IGNORE NULLS) OVER b AS s0, last_value(s.radius IGNORE NULLS) OVER b AS r0,
  first_value(CASE WHEN s.radius IS NOT NULL THEN sector END IGNORE NULLS) OVER a AS s1, first_value(s.radius IGNORE NULLS) OVER a AS r1
  FROM grid2 g LEFT JOIN sect2 s USING (recording_id, pair, side, sector)
  WINDOW b AS (PARTITION BY recording_id, pair, side ORDER BY sector ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id, pair, side ORDER BY sector ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled2 AS (SELECT recording_id, pair, side, sector, CASE WHEN radius IS NOT NULL THEN radius WHEN k <= 2 THEN NULL WHEN s0 IS NULL THEN r1 WHEN s1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * ((sector - s0)::DOUBLE / (s1 - s0)) END AS radius FROM sp2),
k5(o, w) AS (VALUES (-2, -3), (-1, 12), (0, 17), (1, 12), (2, -3)),
smooth2 AS (SELECT recording_id, pair, side, (sector + o + 72) % 72 AS sector, sum(radius * w / 35.0::DOUBLE) AS radius FROM filled2 CROSS JOIN k5 GROUP BY ALL),
vel AS (SELECT recording_id, pair AS frame, sector, (max(radius) FILTER (side = 1) - max(radius) FILTER (side = 0)) * 0.65::DOUBLE / 5 AS velocity FROM smooth2 GROUP BY ALL)
"""
KYMO = VELOCITY + """,
mf AS (SELECT recording_id, max(frame) AS m FROM big GROUP BY ALL),
dense AS (SELECT s.recording_id, s.frame, sector, v.velocity FROM (SELECT recording_id, unnest(range(0, m))::INT AS frame FROM mf) s CROSS JOIN (SELECT unnest(range(0, 72))::INT AS sector) q LEFT JOIN vel v USING (recording_id, frame, sector)),
gk AS (SELECT j::INT AS o, exp(-0.5::DOUBLE * j * j) / (SELECT sum(exp(-0.5::DOUBLE * i * i)) FROM range(-4, 5) r(i)) AS w FROM range(-4, 5) t(j)),
kymo AS (SELECT d.recording_id, d.frame, d.sector, CASE WHEN d.velocity IS NOT NULL THEN sum(coalesce(e.velocity, 0) * w) END AS velocity
  FROM dense d JOIN mf USING (recording_id) CROSS JOIN gk JOIN dense e ON e.recording_id = d.recording_id AND e.sector = d.sector
   AND e.frame = CASE WHEN ((d.frame + o) % (2 * m) + 2 * m) % (2 * m) < m THEN ((d.frame + o) % (2 * m) + 2 * m) % (2 * m) ELSE 2 * m - 1 - ((d.frame + o) % (2 * m) + 2 * m) % (2 * m) END
  GROUP BY d.recording_id, d.frame, d.sector, d.velocity)
"""
RADII = FILL + """,
rk AS (SELECT recording_id, max(frame) AS m FROM filled GROUP BY ALL),
rsp AS (SELECT s.recording_id, s.frame, q.sector, f.radius, count(f.radius) OVER (PARTITION BY s.recording_id, q.sector) AS k FROM (SELECT recording_id, unnest(range(0, m + 1))::INT AS frame FROM rk) s
  JOIN (SELECT DISTINCT recording_id, sector FROM filled) q USING (recording_id) LEFT JOIN filled f ON f.recording_id = s.recording_id AND f.frame = s.frame AND f.sector = q.sector),
rfl AS (SELECT *, last_value(CASE WHEN radius IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0, last_value(radius IGNORE NULLS) OVER b AS r0,
  first_value(CASE WHEN radius IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f1, first_value(radius IGNORE NULLS) OVER a AS r1 FROM rsp WHERE k >= 2
  WINDOW b AS (PARTITION BY recording_id, sector ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id, sector ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rli AS (SELECT recording_id, frame, sector, CASE WHEN radius IS NOT NULL THEN radius WHEN f0 IS NULL THEN r1 WHEN f1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * ((frame - f0)::DOUBLE / (f1 - f0)) END AS radius FROM rfl),
rg AS (SELECT j::INT AS o, exp(-0.5::DOUBLE * (j / 1.5::DOUBLE) * (j / 1.5::DOUBLE)) / (SELECT sum(exp(-0.5::DOUBLE * (i / 1.5::DOUBLE) * (i / 1.5::DOUBLE))) FROM range(-6, 7) r(i)) AS w FROM range(-6, 7) t(j))
"""


@query("edge_kymograph", PX, ctes=KYMO, sql="SELECT recording_id, frame, sector, round(velocity, 6) + 0.0::DOUBLE AS velocity FROM kymo")
def edge_kymograph(px):
    return rounded(E.edge_kymograph(M.largest_component(px), 72), "velocity")


@query("edge_velocity_pair", PX, ctes=VELOCITY, sql="SELECT recording_id, frame, sector, round(velocity, 6) + 0.0::DOUBLE AS velocity FROM vel")
def edge_velocity_pair(px):
    return rounded(E.edge_velocity_pair(M.largest_component(px), 72), "velocity")


@query("edge_summary", PX, ctes=KYMO, sql="""SELECT recording_id, round(CASE WHEN n > 0 THEN coalesce(p, 0) END, 5) AS mean_protrusion_velocity, round(CASE WHEN n > 0 THEN coalesce(r, 0) END, 5) AS mean_retraction_velocity,
  round(np::DOUBLE / nullif(n, 0), 5) AS protrusion_fraction, round(m, 5) AS net_velocity, round(CASE WHEN n > 0 THEN coalesce(hi, 0) END, 5) AS max_protrusion, round(CASE WHEN n > 0 THEN coalesce(lo, 0) END, 5) AS max_retraction
FROM (SELECT recording_id, count(velocity) AS n, avg(velocity) FILTER (velocity > 0) AS p, avg(velocity) FILTER (velocity < 0) AS r, count(*) FILTER (velocity > 0) AS np, avg(velocity) AS m,
  max(velocity) FILTER (velocity > 0) AS hi, min(velocity) FILTER (velocity < 0) AS lo FROM kymo GROUP BY ALL) x""")
def edge_summary(px):
    return rounded(E.edge_summary(E.edge_kymograph(M.largest_component(px), 72)), "mean_protrusion_velocity", "mean_retraction_velocity", "protrusion_fraction", "net_velocity", "max_protrusion", "max_retraction", n=5)


@query("kymograph_limits", PX, ctes=VELOCITY, sql="SELECT recording_id, round(quantile_cont(abs(velocity), 0.95), 5) AS p95, round(max(abs(velocity)), 5) AS max_abs FROM vel GROUP BY ALL")
def kymograph_limits(px):
    return rounded(E.kymograph_limits(E.edge_velocity_pair(M.largest_component(px), 72)), "p95", "max_abs", n=5)


@query("smooth_radii_over_time", PX, ctes=RADII, sql="""SELECT a.recording_id, a.sector, a.frame, round(sum(b.radius * w), 6) AS radius
FROM rli a JOIN rk USING (recording_id) CROSS JOIN rg JOIN rli b ON b.recording_id = a.recording_id AND b.sector = a.sector
 AND b.frame = CASE WHEN ((a.frame + o) % (2 * m + 2) + 2 * m + 2) % (2 * m + 2) < m + 1 THEN ((a.frame + o) % (2 * m + 2) + 2 * m + 2) % (2 * m + 2) ELSE 2 * m + 1 - ((a.frame + o) % (2 * m + 2) + 2 * m + 2) % (2 * m + 2) END
GROUP BY a.recording_id, a.sector, a.frame""")
def smooth_radii_over_time(px):
    return rounded(E.smooth_radii_over_time(E.fill_sector_gaps(E.polar_sectors(M.largest_component(px), 72), 72)), "radius")
