"""Queries of the pixel and shape operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.primitives import gaussian_weights
from strandline.operators import masks as M
from strandline.operators import pixels as P
from strandline.operators import shapes as H
from strandline.plans.q_masks import OUTER
from strandline.plans.q_tracks import rounded
from strandline.plans.registry import query

PX = "pixels"


def _kernel_sql(source: str, value: str, weights: list[float], order: str, other: str, out: str) -> str:
    """One pass of a renormalised kernel in SQL, from lag and lead."""
    r = len(weights) // 2
    at = [f"lag({value}, {k}) OVER w" if k >= 0 else f"lead({value}, {-k}) OVER w" for k in range(r, -r - 1, -1)]
    num = " + ".join(f"coalesce({a} * {w!r}::DOUBLE, 0)" for a, w in zip(at, weights))
    den = " + ".join(f"(CASE WHEN ({a}) IS NULL THEN 0 ELSE {w!r}::DOUBLE END)" for a, w in zip(at, weights))
    return f"SELECT *, ({num}) / ({den}) AS {out} FROM {source} WINDOW w AS (PARTITION BY recording_id, frame, {other} ORDER BY {order})"


G = gaussian_weights(1.0)


def smooth_ctes(source: str = "pixels", tag: str = "") -> str:
    return f"s1{tag} AS ({_kernel_sql(source, 'intensity', G, 'row_', 'col_', 'g1')}),\ns2{tag} AS ({_kernel_sql(f's1{tag}', 'g1', G, 'col_', 'row_', 'g')})"


def gradient_ctes(source: str = "pixels", tag: str = "") -> str:
    return smooth_ctes(source, tag) + f""",
d1{tag} AS (SELECT *, coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g) AS dx, coalesce(lead(g) OVER w, g) + 2 * g + coalesce(lag(g) OVER w, g) AS sx FROM s2{tag} WINDOW w AS (PARTITION BY recording_id, frame, row_ ORDER BY col_)),
grad{tag} AS (SELECT recording_id, frame, row_, col_, sqrt(pow(coalesce(lead(dx) OVER w, dx) + 2 * dx + coalesce(lag(dx) OVER w, dx), 2) + pow(coalesce(lead(sx) OVER w, sx) - coalesce(lag(sx) OVER w, sx), 2)) AS gradient
  FROM d1{tag} WINDOW w AS (PARTITION BY recording_id, frame, col_ ORDER BY row_))"""


DIFF = """
diff0 AS (SELECT *, abs(intensity - lag(intensity) OVER (PARTITION BY recording_id, row_, col_ ORDER BY frame)) AS d FROM pixels),
diff AS (SELECT recording_id, frame, row_, col_, coalesce(d, lead(d) OVER (PARTITION BY recording_id, row_, col_ ORDER BY frame), 0) AS intensity FROM diff0)
"""
SEED_EDGE = """
seed AS (SELECT recording_id, frame, 1 AS label, row_, col_ FROM pixels WHERE intensity >= 128),
""" + OUTER.replace("{src}", "seed") + """,
edge AS (SELECT recording_id, frame, row_, col_ FROM bound)
"""
KEY = "recording_id, frame, row_, col_"


@query("rescale_intensity", PX, ctes="p AS (SELECT recording_id, quantile_cont(intensity, 0.01) AS lo, quantile_cont(intensity, 0.99) AS hi FROM pixels GROUP BY ALL)",
       sql=f"SELECT {KEY}, floor(greatest(0, least(255, (intensity - lo) / (hi - lo) * 255)))::DOUBLE AS intensity FROM pixels JOIN p USING (recording_id)")
def rescale_intensity(px):
    return P.rescale_intensity(px)


@query("collapse_channels", PX, sql="SELECT recording_id, (frame // 3)::INT AS frame, row_, col_, round(avg(intensity), 6) AS intensity FROM pixels GROUP BY ALL")
def collapse_channels(px):
    return rounded(P.collapse_channels(px.withColumn("channel", F.col("frame") % 3).withColumn("frame", F.expr("cast(frame div 3 as int)"))), "intensity")


@query("temporal_background", PX, sql="SELECT recording_id, row_, col_, median(intensity) AS background FROM pixels GROUP BY ALL")
def temporal_background(px):
    return P.temporal_background(px)


@query("subtract_background", PX, ctes="bg AS (SELECT recording_id, row_, col_, median(intensity) AS b FROM pixels GROUP BY ALL)",
       sql=f"SELECT {KEY}, floor(greatest(0, least(255, intensity - b + 128)))::DOUBLE AS intensity FROM pixels JOIN bg USING (recording_id, row_, col_)")
def subtract_background(px):
    return P.subtract_background(px, P.temporal_background(px))


@query("frame_difference", PX, ctes=DIFF, sql="SELECT * FROM diff")
def frame_difference(px):
    return P.frame_difference(px)


@query("gaussian_highpass", PX, ctes=smooth_ctes(), sql=f"SELECT {KEY}, floor(greatest(0, least(255, round(intensity - g + 128, 6))))::DOUBLE AS intensity FROM s2")
def gaussian_highpass(px):
    return P.gaussian_highpass(px)


@query("preprocess_sequence", PX, ctes="bg AS (SELECT recording_id, row_, col_, median(intensity) AS b FROM pixels GROUP BY ALL),\nflat AS (SELECT " + KEY + ", floor(greatest(0, least(255, intensity - b + 128)))::DOUBLE AS intensity FROM pixels JOIN bg USING (recording_id, row_, col_)),\n" + smooth_ctes("flat"),
       sql=f"SELECT {KEY}, floor(greatest(0, least(255, round(intensity - g + 128, 6))))::DOUBLE AS intensity FROM s2")
def preprocess_sequence(px):
    return P.preprocess_sequence(px)


@query("gradient_magnitude", PX, ctes=gradient_ctes(), sql=f"SELECT {KEY}, round(gradient, 5) AS gradient FROM grad")
def gradient_magnitude(px):
    return rounded(P.gradient_magnitude(px), "gradient", n=5)


LOCAL = """
l1 AS (SELECT *, avg(intensity) OVER w AS m1, avg(intensity * intensity) OVER w AS q1 FROM pixels WINDOW w AS (PARTITION BY recording_id, frame, col_ ORDER BY row_ ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
loc AS (SELECT recording_id, frame, row_, col_, sqrt(greatest(0, round(q - m * m, 9))) AS local_std FROM (SELECT *, avg(m1) OVER w AS m, avg(q1) OVER w AS q FROM l1
  WINDOW w AS (PARTITION BY recording_id, frame, row_ ORDER BY col_ ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) x)
"""


@query("local_std", PX, ctes=LOCAL, sql=f"SELECT {KEY}, round(local_std, 5) AS local_std FROM loc")
def local_std(px):
    return rounded(P.local_std(px), "local_std", n=5)


@query("adaptive_threshold", PX, ctes="a1 AS (SELECT *, avg(intensity) OVER (PARTITION BY recording_id, frame, col_ ORDER BY row_ ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m1 FROM pixels)",
       sql=f"SELECT {KEY}, intensity > round(avg(m1) OVER (PARTITION BY recording_id, frame, row_ ORDER BY col_ ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS foreground FROM a1")
def adaptive_threshold(px):
    return P.adaptive_threshold(px)


HIST = """
h0 AS (SELECT recording_id, frame, floor(intensity)::BIGINT AS t, count(*)::DOUBLE AS n FROM pixels GROUP BY ALL),
h AS (SELECT recording_id, frame, t, sum(n) OVER o AS w0, sum(n * t) OVER o AS s0, sum(n) OVER p AS w, sum(n * t) OVER p AS s FROM h0
  WINDOW o AS (PARTITION BY recording_id, frame ORDER BY t), p AS (PARTITION BY recording_id, frame)),
otsu AS (SELECT recording_id, frame, t AS threshold, v AS variance FROM (SELECT *, round(coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2) / (w * w), 0), 6) AS v FROM h) x
  QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY v DESC, t) = 1)
"""


@query("otsu_threshold", PX, ctes=HIST, sql="SELECT recording_id, frame, threshold, round(variance, 4) AS variance FROM otsu")
def otsu_threshold(px):
    return rounded(P.otsu_threshold(px), "variance", n=4)


@query("multi_otsu", PX, ctes=HIST, sql="""SELECT recording_id, frame, t1, t2, round(v, 4) AS variance FROM (
  SELECT a.recording_id, a.frame, a.t AS t1, b.t AS t2, round((a.s0 * a.s0 / a.w0 + pow(b.s0 - a.s0, 2) / (b.w0 - a.w0) + pow(b.s - b.s0, 2) / (b.w - b.w0)) / b.w - pow(b.s / b.w, 2), 6) AS v
  FROM h a JOIN h b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.t < b.t AND b.w0 < b.w) x QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY v DESC, t1, t2) = 1""")
def multi_otsu(px):
    return rounded(P.multi_otsu(px), "variance", n=4)


@query("best_candidate_by_iou", PX, ctes=HIST + """,
c AS (SELECT p.recording_id, p.frame, row_, col_, CASE WHEN intensity > threshold THEN 'above' ELSE 'below' END AS candidate, intensity >= 128 AS ref FROM pixels p JOIN otsu USING (recording_id, frame)),
i AS (SELECT recording_id, frame, candidate, count(*) AS n, count(*) FILTER (ref) AS b FROM c GROUP BY ALL),
m AS (SELECT recording_id, frame, count(*) FILTER (ref) AS m FROM c GROUP BY ALL)
""", sql="SELECT recording_id, frame, candidate, round(iou, 6) AS iou FROM (SELECT *, b::DOUBLE / (n + m - b) AS iou FROM i JOIN m USING (recording_id, frame)) x QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY iou DESC, candidate) = 1")
def best_candidate_by_iou(px):
    return rounded(P.otsu_mask(px, P.seed_mask(px)), "iou")


@query("texture_mask", PX)
def texture_mask(px):
    return P.texture_mask(px)


@query("boundary_confidence", PX, ctes=gradient_ctes() + "," + SEED_EDGE, sql="SELECT recording_id, frame, round(avg(gradient), 4) AS confidence FROM grad JOIN edge USING (recording_id, frame, row_, col_) GROUP BY ALL")
def boundary_confidence(px):
    return rounded(P.boundary_confidence(px, P.seed_mask(px)), "confidence", n=4)


MQ = DIFF + """,
mm AS (SELECT d.*, p.intensity >= 128 AS inside, quantile_cont(d.intensity, 0.8) OVER (PARTITION BY d.recording_id, d.frame) AS cut FROM diff d JOIN pixels p USING (recording_id, frame, row_, col_)),
mg AS (SELECT recording_id, frame, avg(intensity) FILTER (inside) AS mi, coalesce(avg(intensity) FILTER (NOT inside), 0.001) AS mo, max(intensity) AS peak,
  count(*) FILTER (inside AND intensity >= cut) AS b, count(*) FILTER (intensity >= cut) AS hot, count(*) FILTER (inside) AS area FROM mm GROUP BY ALL),
mq AS (SELECT recording_id, frame, CASE WHEN area = 0 OR peak = 0 THEN 0 ELSE 0.3::DOUBLE * greatest(0, least(1, (mi / greatest(mo, 0.001) - 0.5::DOUBLE) / 1.5::DOUBLE))
  + 0.5::DOUBLE * greatest(0, least(1, b::DOUBLE / greatest(hot, 1) / 0.5::DOUBLE)) + 0.2::DOUBLE * (1 - greatest(0, least(1, abs(ln(hot::DOUBLE / greatest(area, 1))) / 1.5::DOUBLE))) END AS quality FROM mg)
"""


@query("motion_quality", PX, ctes=MQ, sql="SELECT recording_id, frame, round(quality, 6) AS quality FROM mq")
def motion_quality(px):
    return rounded(P.motion_quality(P.frame_difference(px), P.seed_mask(px)), "quality")


@query("mean_flow_quality", PX, ctes=MQ, sql="SELECT recording_id, round(avg(quality), 6) AS mean_quality FROM mq GROUP BY ALL")
def mean_flow_quality(px):
    return rounded(P.mean_flow_quality(P.motion_quality(P.frame_difference(px), P.seed_mask(px))), "mean_quality")


@query("motion_edge_agreement", PX, ctes=DIFF + "," + gradient_ctes() + "," + gradient_ctes("diff", "m") + "," + SEED_EDGE + """,
b2 AS (SELECT a.*, b.gradient AS moving FROM grad a JOIN gradm b USING (recording_id, frame, row_, col_)),
pp AS (SELECT recording_id, frame, quantile_cont(gradient, 0.9) AS pa, quantile_cont(moving, 0.9) AS pb FROM b2 GROUP BY ALL),
ee AS (SELECT recording_id, frame, avg(gradient) AS a, avg(moving) AS m, corr(gradient, moving) AS r, count(*) AS n FROM b2 JOIN edge USING (recording_id, frame, row_, col_) GROUP BY ALL)
""", sql="""SELECT recording_id, frame, round(0.4::DOUBLE * a / greatest(pa, 1e-6) + 0.4::DOUBLE * m / greatest(pb, 1e-6) + 0.2::DOUBLE * greatest(0, CASE WHEN n > 4 AND NOT isnan(coalesce(r, 0)) THEN coalesce(r, 0) ELSE 0 END), 5) AS agreement
FROM ee JOIN pp USING (recording_id, frame)""")
def motion_edge_agreement(px):
    return rounded(P.motion_edge_agreement(px, P.frame_difference(px), P.seed_mask(px)), "agreement", n=5)


@query("augment_pairs", PX, ctes="""
u AS (SELECT *, (('0x' || substr(md5('aug-u-' || recording_id || '-' || frame || '-' || row_ || '-' || col_), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u1,
  (('0x' || substr(md5('aug-v-' || recording_id || '-' || frame || '-' || row_ || '-' || col_), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u2,
  (('0x' || substr(md5('aug-g-' || recording_id || '-' || frame), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u3 FROM pixels)
""", sql="""SELECT recording_id, frame, 'noise' AS variant, row_, col_, round(greatest(0, least(255, intensity + sqrt(-2 * ln(u1)) * cos(6.283185307179586 * u2) * 6)), 5) AS intensity FROM u
UNION ALL SELECT recording_id, frame, 'gamma', row_, col_, round(255 * pow(intensity / 255, 0.8::DOUBLE + 0.45::DOUBLE * u3), 5) FROM u
UNION ALL SELECT recording_id, frame, 'flip', row_, 7 - col_, intensity FROM u""")
def augment_pairs(px):
    return rounded(P.augment_pairs(px), "intensity", n=5)


@query("roi_rect", PX, sql=f"SELECT {KEY}, CASE WHEN row_ >= 1 AND row_ < 6 AND col_ >= 2 AND col_ < 8 THEN intensity ELSE 7.0::DOUBLE END AS intensity FROM pixels")
def roi_rect(px):
    return M.roi_rect(px, 1, 6, 2, 12, 7.0)


@query("roi_ellipse", PX, sql=f"SELECT {KEY}, CASE WHEN pow((col_ - 3.5::DOUBLE) / 3, 2) + pow((row_ - 4.0::DOUBLE) / 2, 2) <= 1 THEN intensity ELSE 0 END AS intensity FROM pixels")
def roi_ellipse(px):
    return M.roi_ellipse(px, 4.0, 3.5, 2.0, 3.0)


@query("roi_polygon", PX, ctes="e(y1, x1, y2, x2) AS (VALUES (0.5::DOUBLE, 0.5::DOUBLE, 6.5::DOUBLE, 1.25::DOUBLE), (6.5, 1.25, 3.5, 6.75), (3.5, 6.75, 0.5, 0.5))", sql=f"""SELECT {KEY}, CASE WHEN (SELECT count(*) FROM e WHERE row_ >= least(y1, y2) AND row_ < greatest(y1, y2)
  AND col_ < x1 + (row_ - y1) * ((x2 - x1) / (y2 - y1))) % 2 = 1 THEN intensity ELSE 0 END AS intensity FROM pixels""")
def roi_polygon(px):
    return M.roi_polygon(px, [(0.5, 0.5), (6.5, 1.25), (3.5, 6.75)])


def _labelled(px):
    return px.where("frame % 2 = 0").select(*P.PIXEL, (F.col("intensity") >= 128).cast("double").alias("label"))


@query("kmeans_pixels", PX)
def kmeans_pixels(px):
    return P.kmeans_pixels(px)


@query("gmm_pixels", PX)
def gmm_pixels(px):
    return P.gmm_pixels(px)


@query("rf_pixels", PX)
def rf_pixels(px):
    return P.rf_pixels(px, _labelled(px))


@query("ensemble_probability", PX)
def ensemble_probability(px):
    return P.ensemble_probability(px, _labelled(px))


SV = "shape_vectors"


@query("shape_heterogeneity", SV, sql="""SELECT 10 AS k, round(-sum(CASE WHEN p > 0 THEN p * log2(p) END), 6) AS entropy, round(log2(10), 6) AS max_entropy, round(-sum(CASE WHEN p > 0 THEN p * log2(p) END) / greatest(log2(10), 1), 6) AS normalised
FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM shape_vectors GROUP BY mode_id) x""")
def shape_heterogeneity(v):
    return rounded(H.shape_heterogeneity(v, 10), "entropy", "max_entropy", "normalised")


@query("mode_fractions", SV, sql="SELECT m::INT AS mode_id, count(mode_id) AS n, round(count(mode_id)::DOUBLE / sum(count(mode_id)) OVER (), 6) AS fraction FROM range(0, 12) r(m) LEFT JOIN shape_vectors ON mode_id = m GROUP BY m")
def mode_fractions(v):
    return rounded(H.mode_fractions(v, 12), "fraction")


@query("frame_modes", SV, sql="SELECT f::BIGINT AS frame, mode_id FROM (SELECT unnest(range(0, max(vec_id) + 1)) AS f FROM shape_vectors) s LEFT JOIN (SELECT * FROM shape_vectors WHERE vec_id % 7 <> 0) v ON vec_id = f")
def frame_modes(v):
    return H.frame_modes(v.where("vec_id % 7 <> 0"), v)


@query("shape_pca", SV)
def shape_pca(v):
    return H.shape_pca(v).select("vec_id", "scores")


@query("shape_components", SV)
def shape_components(v):
    return H.shape_components(v)


@query("shape_modes", SV)
def shape_modes(v):
    return H.shape_modes(v)


@query("eigenshapes", SV)
def eigenshapes(v):
    return H.eigenshapes(v)


@query("shape_vectors", "mask_px")
def shape_vectors(px):
    return H.shape_vectors(M.largest_component(px))
