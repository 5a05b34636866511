"""Queries of the trajectory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import tracks as T
from strandline.plans.registry import query

TP = "track_points"


def rounded(df, *cols, n=6):
    """Columns rounded as DuckDB's round does it: the scaled value to the nearest integer, halves away from zero (Spark's round goes by the decimal text)."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**n) / 10.0**n for c in cols})


STEPS = """
steps AS (
  SELECT recording_id, track_id, frame, sqrt((ny - cy) * (ny - cy) + (nx - cx) * (nx - cx)) AS step
  FROM (SELECT *, lead(cy) OVER w AS ny, lead(cx) OVER w AS nx, lead(frame) OVER w AS nf FROM track_points
        WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame)) x WHERE nf IS NOT NULL),
ends AS (
  SELECT recording_id, track_id, count(*) AS n_frames, count(cy) AS n_valid,
         arg_min(cy, frame) FILTER (cy IS NOT NULL) AS y0, arg_min(cx, frame) FILTER (cy IS NOT NULL) AS x0,
         arg_max(cy, frame) FILTER (cy IS NOT NULL) AS y1, arg_max(cx, frame) FILTER (cy IS NOT NULL) AS x1
  FROM track_points GROUP BY ALL),
summed AS (SELECT recording_id, track_id, avg(step) / 5.0::DOUBLE AS mean_speed, coalesce(sum(step), 0) AS total FROM steps GROUP BY ALL),
tracked AS (
  SELECT e.recording_id, e.track_id, n_frames, n_valid, mean_speed, coalesce(total, 0) AS total,
         CASE WHEN n_valid >= 2 THEN sqrt((y1 - y0) * (y1 - y0) + (x1 - x0) * (x1 - x0)) END AS net
  FROM ends e LEFT JOIN summed s USING (recording_id, track_id))
"""
COMPACT = """
comp AS (
  SELECT recording_id, track_id, cy, cx, (row_number() OVER (PARTITION BY recording_id, track_id ORDER BY frame) - 1)::INT AS idx,
         count(*) OVER (PARTITION BY recording_id, track_id)::INT AS n
  FROM track_points WHERE cy IS NOT NULL AND cx IS NOT NULL)
"""
MSD = COMPACT + """,
curve AS (
  SELECT a.recording_id, a.track_id, (b.idx - a.idx)::INT AS lag,
         avg((b.cy - a.cy) * (b.cy - a.cy) + (b.cx - a.cx) * (b.cx - a.cx)) AS msd,
         stddev_pop((b.cy - a.cy) * (b.cy - a.cy) + (b.cx - a.cx) * (b.cx - a.cx)) / sqrt(count(*)) AS sem
  FROM comp a JOIN comp b ON a.recording_id = b.recording_id AND a.track_id = b.track_id AND b.idx > a.idx AND b.idx - a.idx <= a.n // 2 - 1
  GROUP BY ALL)
"""


@query("px_to_um", TP, sql="SELECT recording_id, track_id, frame, round(cy * 0.65::DOUBLE, 6) AS cy, round(cx * 0.65::DOUBLE, 6) AS cx FROM track_points")
def px_to_um(p):
    return rounded(T.px_to_um(p), "cy", "cx").select("recording_id", "track_id", "frame", "cy", "cx")


@query("frame_to_time", TP, sql="SELECT recording_id, track_id, frame, frame * 5.0::DOUBLE AS time_min FROM track_points")
def frame_to_time(p):
    return T.frame_to_time(p).select("recording_id", "track_id", "frame", "time_min")


@query("polar_coords", TP, sql="SELECT recording_id, track_id, frame, round(atan2(cy - 50, cx - 50), 6) AS angle, round(sqrt((cy - 50) * (cy - 50) + (cx - 50) * (cx - 50)), 6) AS radius FROM track_points")
def polar_coords(p):
    return rounded(T.polar_coords(p, 50.0, 50.0), "angle", "radius").select("recording_id", "track_id", "frame", "angle", "radius")


@query("trajectory_origin", TP, ctes=STEPS, sql="SELECT p.recording_id, p.track_id, frame, round(cy - y0, 6) + 0.0::DOUBLE AS cy, round(cx - x0, 6) + 0.0::DOUBLE AS cx FROM track_points p JOIN ends USING (recording_id, track_id)")
def trajectory_origin(p):
    return rounded(T.trajectory_origin(p), "cy", "cx")


@query("instantaneous_speed", TP, ctes=STEPS, sql="SELECT recording_id, track_id, frame, round(step / 5.0::DOUBLE, 6) AS speed FROM steps")
def instantaneous_speed(p):
    return rounded(T.instantaneous_speed(p), "speed")


@query("mean_speed", TP, ctes=STEPS, sql="SELECT recording_id, track_id, round(mean_speed, 6) AS mean_speed FROM summed")
def mean_speed(p):
    return rounded(T.mean_speed(p), "mean_speed")


@query("total_distance", TP, ctes=STEPS, sql="SELECT recording_id, track_id, round(total, 6) AS total_distance FROM summed")
def total_distance(p):
    return rounded(T.total_distance(p), "total_distance")


@query("net_displacement", TP, ctes=STEPS, sql="SELECT recording_id, track_id, round(net, 6) AS net_displacement FROM tracked")
def net_displacement(p):
    return rounded(T.net_displacement(p), "net_displacement")


@query("persistence_ratio", TP, ctes=STEPS, sql="SELECT recording_id, track_id, round(net / total, 6) AS persistence FROM (SELECT recording_id, track_id, net, nullif(total, 0) AS total FROM tracked JOIN summed USING (recording_id, track_id)) x".replace("tracked JOIN summed USING (recording_id, track_id)", "tracked WHERE mean_speed IS NOT NULL OR n_frames > 1"))
def persistence_ratio(p):
    return rounded(T.persistence_ratio(p), "persistence")


@query("msd", TP, ctes=MSD, sql="SELECT recording_id, track_id, lag, round(msd, 9) AS msd, round(sem, 9) AS sem FROM curve")
def msd(p):
    return rounded(T.msd(p), "msd", "sem", n=9)


@query("direction_autocorrelation", TP, ctes=COMPACT + """,
units AS (
  SELECT recording_id, track_id, idx, n, dy / greatest(sqrt(dy * dy + dx * dx), 1e-8) AS uy, dx / greatest(sqrt(dy * dy + dx * dx), 1e-8) AS ux
  FROM (SELECT *, lead(cy) OVER w - cy AS dy, lead(cx) OVER w - cx AS dx FROM comp WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY idx)) x
  WHERE dy IS NOT NULL AND n >= 3)
""", sql="""SELECT a.recording_id, a.track_id, (b.idx - a.idx)::INT AS lag,
  round(avg(CASE WHEN a.idx = b.idx THEN 1.0::DOUBLE ELSE a.uy * b.uy + a.ux * b.ux END), 6) AS autocorrelation,
  round(stddev_pop(CASE WHEN a.idx = b.idx THEN 1.0::DOUBLE ELSE a.uy * b.uy + a.ux * b.ux END) / sqrt(count(*)), 6) AS sem
FROM units a JOIN units b ON a.recording_id = b.recording_id AND a.track_id = b.track_id AND b.idx >= a.idx AND b.idx - a.idx <= (a.n - 1) // 2 - 1 GROUP BY ALL""")
def direction_autocorrelation(p):
    return rounded(T.direction_autocorrelation(p), "autocorrelation", "sem")


@query("msd_diffusion_fit", TP, ctes=MSD, sql="""SELECT recording_id, track_id, round(CASE WHEN n >= 3 THEN pow(10, i) / 4 ELSE 0 END, 4) AS d, round(CASE WHEN n >= 3 THEN s ELSE 1 END, 6) AS alpha,
  round(CASE WHEN n >= 3 THEN r ELSE 0 END, 6) AS r_squared
FROM (SELECT recording_id, track_id, count(*) AS n, regr_intercept(log10(msd), log10(lag * 5.0::DOUBLE)) AS i, regr_slope(log10(msd), log10(lag * 5.0::DOUBLE)) AS s,
  regr_r2(log10(msd), log10(lag * 5.0::DOUBLE)) AS r FROM curve WHERE msd > 0 GROUP BY ALL) x""")
def msd_diffusion_fit(p):
    fit = T.msd_diffusion_fit(T.msd(p))
    return fit.select("recording_id", "track_id", F.round("d", 4).alias("d"), F.round("alpha", 6).alias("alpha"), F.round("r_squared", 6).alias("r_squared"))


@query("smooth_trajectory", TP, ctes=COMPACT.replace("cy, cx,", "frame, cy, cx,") + """,
taps AS (SELECT k AS o, exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) * (k / 1.5::DOUBLE)) / (SELECT sum(exp(-0.5::DOUBLE * (j / 1.5::DOUBLE) * (j / 1.5::DOUBLE))) FROM range(-6, 7) r(j)) AS w FROM range(-6, 7) t(k)),
smooth AS (
  SELECT c.recording_id, c.track_id, c.frame, sum(d.cy * w) AS cy, sum(d.cx * w) AS cx
  FROM comp c CROSS JOIN taps JOIN comp d ON d.recording_id = c.recording_id AND d.track_id = c.track_id
   AND d.idx = CASE WHEN ((c.idx + o) % (2 * c.n) + 2 * c.n) % (2 * c.n) < c.n THEN ((c.idx + o) % (2 * c.n) + 2 * c.n) % (2 * c.n) ELSE 2 * c.n - 1 - ((c.idx + o) % (2 * c.n) + 2 * c.n) % (2 * c.n) END
  WHERE c.n >= 3 GROUP BY ALL)
""", sql="""SELECT p.recording_id, p.track_id, p.frame, round(coalesce(s.cy, p.cy), 6) AS cy, round(coalesce(s.cx, p.cx), 6) AS cx
FROM track_points p LEFT JOIN smooth s USING (recording_id, track_id, frame)""")
def smooth_trajectory(p):
    return rounded(T.smooth_trajectory(p), "cy", "cx")


@query("analyze_recording", TP, ctes=STEPS, sql="""SELECT recording_id, track_id, n_frames, n_valid, round(mean_speed, 6) AS mean_speed, round(total, 6) AS total_distance, round(net, 6) AS net_displacement,
  round(net / nullif(total, 0), 6) AS persistence FROM tracked""")
def analyze_recording(p):
    return rounded(T.analyze_recording(p), "mean_speed", "total_distance", "net_displacement", "persistence")


@query("series_by_cell", TP, ctes=STEPS, sql="""SELECT recording_id, track_id, frame, round(speed, 6) AS speed, round(m, 6) AS mean, round(m - s, 6) AS low, round(m + s, 6) AS high
FROM (SELECT *, avg(speed) OVER w AS m, stddev_pop(speed) OVER w AS s FROM (SELECT recording_id, track_id, frame, step / 5.0::DOUBLE AS speed FROM steps) x WINDOW w AS (PARTITION BY recording_id, frame)) y""")
def series_by_cell(p):
    return rounded(T.series_by_cell(p), "speed", "mean", "low", "high")


@query("cell_series", TP, ctes=STEPS + """,
first AS (SELECT recording_id, track_id, arg_min(cy, frame) AS y0, arg_min(cx, frame) AS x0 FROM track_points WHERE cy IS NOT NULL AND cx IS NOT NULL GROUP BY ALL),
every AS (SELECT 'speed_um_min' AS metric, recording_id, track_id, frame, step * 0.65::DOUBLE / 5 AS value FROM steps
  UNION ALL SELECT 'path_y_um', recording_id, track_id, frame, (cy - y0) * 0.65::DOUBLE FROM track_points JOIN first USING (recording_id, track_id)
  UNION ALL SELECT 'path_x_um', recording_id, track_id, frame, (cx - x0) * 0.65::DOUBLE FROM track_points JOIN first USING (recording_id, track_id)
  UNION ALL SELECT 'area_um2', recording_id, track_id, frame, (100 + frame * 7 % 50) * 0.4225::DOUBLE FROM track_points)
""", sql="""SELECT metric, recording_id, track_id, frame, round(value, 5) AS value, round(m, 5) AS mean, round(m - s, 5) AS low, round(m + s, 5) AS high
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM every WHERE value IS NOT NULL WINDOW w AS (PARTITION BY metric, recording_id, frame)) y""")
def cell_series(p):
    return rounded(T.cell_series(p.withColumn("area_px", 100 + F.col("frame") * 7 % 50)), "value", "mean", "low", "high", n=5)


@query("track_summary", TP, ctes=STEPS, sql="""SELECT p.recording_id, p.track_id, p.frames_tracked, p.first_frame, round(mean_speed, 6) AS mean_speed,
  dense_rank() OVER (PARTITION BY p.recording_id ORDER BY p.track_id)::INT AS cell_id
FROM (SELECT recording_id, track_id, count(*) AS frames_tracked, min(frame) AS first_frame FROM track_points WHERE cy IS NOT NULL GROUP BY ALL) p LEFT JOIN summed USING (recording_id, track_id)""")
def track_summary(p):
    return rounded(T.track_summary(p), "mean_speed")


@query("per_cell_timeseries_csv", TP, ctes=STEPS, sql="""SELECT p.recording_id, p.track_id, p.frame, p.frame * 5.0::DOUBLE AS time_min, round(cy, 6) AS cy, round(cx, 6) AS cx, round(step / 5.0::DOUBLE, 6) AS speed
FROM track_points p LEFT JOIN steps USING (recording_id, track_id, frame)""")
def per_cell_timeseries_csv(p):
    return rounded(T.per_cell_timeseries(p), "cy", "cx", "speed")
