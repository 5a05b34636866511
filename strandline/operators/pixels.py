"""Operators over pixel tables: pixels(recording_id, frame, row_, col_, intensity), dense rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.primitives import gaussian_weights
from strandline.functions.quantiles import exact_quantiles
from strandline.operators import masks as M

PIXEL = ["recording_id", "frame", "row_", "col_"]
FRAME = ["recording_id", "frame"]


def down() -> WindowSpec:
    return W.partitionBy(*FRAME, "col_").orderBy("row_")


def right() -> WindowSpec:
    return W.partitionBy(*FRAME, "row_").orderBy("col_")


def through() -> WindowSpec:
    return W.partitionBy("recording_id", "row_", "col_").orderBy("frame")


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def rescale_intensity(px: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """0..255 between two percentiles of the whole recording, clipped; with equal percentiles between min and max, else 0."""
    ends = exact_quantiles(px, ["recording_id"], "intensity", {"a": 0.0, "low": low, "high": high, "b": 1.0})
    flat = F.col("low") == F.col("high")
    p = ends.select("recording_id", F.when(flat, F.col("a")).otherwise(F.col("low")).alias("lo"), F.when(flat, F.col("b")).otherwise(F.col("high")).alias("hi"))
    v = (F.col("intensity") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255
    out = F.when(F.col("hi") > F.col("lo"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)))).otherwise(0).cast("double")
    return px.join(p, "recording_id").select(*PIXEL, out.alias("intensity"))


def collapse_channels(px: DataFrame) -> DataFrame:
    """Mean over the channels of (pixel, channel, intensity)."""
    return px.groupBy(*PIXEL).agg(F.avg("intensity").alias("intensity"))


def temporal_background(px: DataFrame, method: str = "median") -> DataFrame:
    """Per pixel the median, mean, min or max over all frames."""
    f = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}[method]
    return px.groupBy("recording_id", "row_", "col_").agg(f("intensity").alias("background"))


def subtract_background(px: DataFrame, background: DataFrame, offset: float = 128.0) -> DataFrame:
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("intensity") - F.col("background") + offset))).cast("double")
    return px.join(background, ["recording_id", "row_", "col_"]).select(*PIXEL, v.alias("intensity"))


def frame_difference(px: DataFrame) -> DataFrame:
    """|I(t) - I(t - 1)|; the first frame mirrors the second."""
    d = F.abs(F.col("intensity") - F.lag("intensity").over(through()))
    return px.withColumn("_d", d).select(*PIXEL, F.coalesce("_d", F.lead("_d").over(through()), F.lit(0.0)).alias("intensity"))


def separable(px: DataFrame, value: str, weights: list[float], out: str) -> DataFrame:
    """Two passes of a 1-D kernel, weights renormalised where the frame ends: lag and lead over sorted lines, two shuffles."""
    r = len(weights) // 2

    def one(source: str, w: WindowSpec) -> Column:
        at = [F.lag(source, k).over(w) if k >= 0 else F.lead(source, -k).over(w) for k in range(r, -r - 1, -1)]
        return _total([F.coalesce(v * x, F.lit(0.0)) for v, x in zip(at, weights)]) / _total([F.when(v.isNotNull(), x).otherwise(0.0) for v, x in zip(at, weights)])

    return px.withColumn("_v", one(value, down())).withColumn(out, one("_v", right())).drop("_v")


def gaussian_highpass(px: DataFrame, sigma: float = 1.0, offset: float = 128.0) -> DataFrame:
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(F.col("intensity") - F.col("_g") + offset, 6)))).cast("double")
    return separable(px, "intensity", gaussian_weights(sigma), "_g").select(*PIXEL, v.alias("intensity"))


def preprocess_sequence(px: DataFrame, background: bool = True, highpass: bool = True, sigma: float = 1.0) -> DataFrame:
    """Background subtraction, then high-pass, each optional."""
    px = subtract_background(px, temporal_background(px)) if background else px
    return gaussian_highpass(px, sigma) if highpass else px


def gradient_magnitude(px: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian, then the magnitude of the 3 x 3 Sobel gradient, edge values repeated."""
    g = separable(px, "intensity", gaussian_weights(sigma), "g")
    near = lambda c, k, w: F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.col(c))
    g = g.withColumn("dx", near("g", -1, right()) - near("g", 1, right())).withColumn("sx", near("g", -1, right()) + 2 * F.col("g") + near("g", 1, right()))
    gx = near("dx", -1, down()) + 2 * F.col("dx") + near("dx", 1, down())
    gy = near("sx", -1, down()) - near("sx", 1, down())
    return g.select(*PIXEL, F.sqrt(gx * gx + gy * gy).alias("gradient"))


def local_std(px: DataFrame, k: int = 1) -> DataFrame:
    """Standard deviation in the (2k + 1)-square box, cut at the frame's ends."""
    for name, source in (("_m", F.col("intensity")), ("_q", F.col("intensity") * F.col("intensity"))):
        px = px.withColumn(name, source)
        px = px.withColumn(name, F.avg(name).over(down().rowsBetween(-k, k))).withColumn(name, F.avg(name).over(right().rowsBetween(-k, k)))
    return px.select(*PIXEL, F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("_q") - F.col("_m") * F.col("_m"), 9))).alias("local_std"))


def adaptive_threshold(px: DataFrame, k: int = 2) -> DataFrame:
    """Foreground where the value exceeds the mean of its (2k + 1)-square box."""
    m = px.withColumn("_m", F.avg("intensity").over(down().rowsBetween(-k, k))).withColumn("_m", F.avg("_m").over(right().rowsBetween(-k, k)))
    return m.select(*PIXEL, (F.col("intensity") > F.round("_m", 9)).alias("foreground"))


def _histogram(px: DataFrame, value: str) -> DataFrame:
    """Per frame and whole value: rows, cumulative rows and values, totals. At most 256 rows a frame for 8-bit values."""
    h = px.groupBy(*FRAME, F.floor(value).alias("t")).agg(F.count("*").cast("double").alias("n"))
    w, whole = W.partitionBy(*FRAME).orderBy("t"), W.partitionBy(*FRAME)
    s = F.col("n") * F.col("t")
    return h.select(*FRAME, "t", F.sum("n").over(w).alias("w0"), F.sum(s).over(w).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(s).over(whole).alias("s"))


def otsu_threshold(px: DataFrame, value: str = "intensity") -> DataFrame:
    """Per frame the whole value t whose classes <= t and > t have the largest between-class variance (lowest among equals)."""
    h = _histogram(px, value)
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.expr("nullif(w - w0, 0)")
    var = F.coalesce(F.col("w0") * (F.col("w") - F.col("w0")) * d * d / (F.col("w") * F.col("w")), F.lit(0.0))
    best = F.max(F.struct(F.round(var, 6).alias("v"), (-F.col("t")).alias("t")))
    return h.groupBy(*FRAME).agg(best.alias("b")).select(*FRAME, (-F.col("b.t")).alias("threshold"), F.col("b.v").alias("variance"))


def multi_otsu(px: DataFrame, value: str = "intensity") -> DataFrame:
    """Two thresholds t1 < t2 of largest between-class variance over three classes; pairs stay within a frame's histogram."""
    h = _histogram(px, value)
    a = h.select(*FRAME, F.col("t").alias("t1"), F.col("w0").alias("wa"), F.col("s0").alias("sa"))
    p = a.join(h, FRAME).where("t1 < t and w0 < w")
    part = lambda s, n: s * s / n
    var = (part(F.col("sa"), F.col("wa")) + part(F.col("s0") - F.col("sa"), F.col("w0") - F.col("wa")) + part(F.col("s") - F.col("s0"), F.col("w") - F.col("w0"))) / F.col("w") - (F.col("s") / F.col("w")) ** 2
    best = F.max(F.struct(F.round(var, 6).alias("v"), (-F.col("t1")).alias("t1"), (-F.col("t")).alias("t2")))
    return p.groupBy(*FRAME).agg(best.alias("b")).select(*FRAME, (-F.col("b.t1")).alias("t1"), (-F.col("b.t2")).alias("t2"), F.col("b.v").alias("variance"))


def otsu_mask(px: DataFrame, reference: DataFrame) -> DataFrame:
    """Either side of the threshold, whichever overlaps the reference better: columns candidate ('above' or 'below') and iou."""
    t = px.join(otsu_threshold(px), FRAME)
    c = t.select(*FRAME, "row_", "col_", F.when(F.col("intensity") > F.col("threshold"), "above").otherwise("below").alias("candidate"))
    return M.best_candidate_by_iou(c, reference)


def texture_mask(px: DataFrame, k: int = 1, min_area: int = 4) -> DataFrame:
    """Pixels whose local deviation exceeds its own threshold; the largest connected part of min_area pixels."""
    s = local_std(px, k)
    rough = s.join(otsu_threshold(s, "local_std"), FRAME).where(F.floor("local_std") > F.col("threshold")).select(*PIXEL)
    return M.largest_component(M.connected_components(rough), min_area)


def seed_mask(px: DataFrame, least: float = 128.0) -> DataFrame:
    return px.where(F.col("intensity") >= least).select(*FRAME, F.lit(1).alias("label"), "row_", "col_")


def boundary_confidence(px: DataFrame, mask: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Mean gradient magnitude on the mask's boundary per frame."""
    edge = M.boundary_pixels(mask).select(*PIXEL).distinct()
    return gradient_magnitude(px, sigma).join(edge, PIXEL).groupBy(*FRAME).agg(F.avg("gradient").alias("confidence"))


def motion_quality(motion: DataFrame, mask: DataFrame) -> DataFrame:
    """Score in 0..1 of how well motion (column intensity) and mask agree per frame: inside / outside ratio, overlap with
    the top fifth of motion, and area ratio; 0 without a mask or motion."""
    m = motion.join(mask.select(*PIXEL).distinct().withColumn("_in", F.lit(True)), PIXEL, "left").withColumn("inside", F.col("_in").isNotNull())
    top = m.groupBy(*FRAME).agg(F.percentile("intensity", F.lit(0.8)).alias("cut"))
    hot = F.col("intensity") >= F.col("cut")
    g = m.join(top, FRAME).groupBy(*FRAME).agg(
        F.avg(F.when(F.col("inside"), F.col("intensity"))).alias("mi"), F.coalesce(F.avg(F.when(~F.col("inside"), F.col("intensity"))), F.lit(0.001)).alias("mo"), F.max("intensity").alias("peak"),
        F.count(F.when(hot & F.col("inside"), 1)).alias("both"), F.count(F.when(hot, 1)).alias("hot"), F.count(F.when(F.col("inside"), 1)).alias("area"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ratio = F.col("mi") / F.greatest("mo", F.lit(0.001))
    # Weights and limits of the three parts.
    score = 0.3 * clip((ratio - 0.5) / 1.5) + 0.5 * clip(F.col("both") / F.greatest("hot", F.lit(1)) / 0.5) + 0.2 * (1 - clip(F.abs(F.log(F.col("hot") / F.greatest("area", F.lit(1)))) / 1.5))
    return g.select(*FRAME, F.when((F.col("area") == 0) | (F.col("peak") == 0), 0.0).otherwise(score).alias("quality"))


def mean_flow_quality(quality: DataFrame) -> DataFrame:
    return quality.groupBy("recording_id").agg(F.avg("quality").alias("mean_quality"))


def motion_edge_agreement(px: DataFrame, motion: DataFrame, mask: DataFrame, sigma: float = 1.0) -> DataFrame:
    """0.4 image + 0.4 motion gradient on the boundary (each over its 90th percentile of the frame) + 0.2 max(0, correlation)."""
    a, b = gradient_magnitude(px, sigma), gradient_magnitude(motion, sigma).withColumnRenamed("gradient", "moving")
    both = a.join(b, PIXEL)
    p = both.groupBy(*FRAME).agg(F.percentile("gradient", F.lit(0.9)).alias("pa"), F.percentile("moving", F.lit(0.9)).alias("pb"))
    edge = both.join(M.boundary_pixels(mask).select(*PIXEL).distinct(), PIXEL)
    g = edge.groupBy(*FRAME).agg(F.avg("gradient").alias("a"), F.avg("moving").alias("b"), F.corr("gradient", "moving").alias("r"), F.count("*").alias("n")).join(p, FRAME)
    r = F.when(F.col("n") > 4, F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))).otherwise(0.0)
    score = 0.4 * F.col("a") / F.greatest("pa", F.lit(1e-6)) + 0.4 * F.col("b") / F.greatest("pb", F.lit(1e-6)) + 0.2 * F.greatest(F.lit(0.0), r)
    return g.select(*FRAME, score.alias("agreement"))


def _vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def kmeans_pixels(px: DataFrame, k: int = 3, height: int = 8, width: int = 8, seed: int = 42) -> DataFrame:
    """Cluster of every pixel over (value, 50 row / h, 50 col / w); one model over all frames."""
    f = _vectors(px.withColumn("_y", 50 * F.col("row_") / height).withColumn("_x", 50 * F.col("col_") / width), ["intensity", "_y", "_x"])
    return KMeans(k=k, seed=seed, maxIter=20).fit(f).transform(f).select(*PIXEL, F.col("prediction").alias("cluster"))


def gmm_pixels(px: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """Probability of the mixture component with the highest mean deviation, over (value, local deviation)."""
    f = _vectors(px.join(local_std(px), PIXEL), ["intensity", "local_std"])
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(f)
    rough = max(range(k), key=lambda i: model.gaussians[i].mean[1])
    return model.transform(f).select(*PIXEL, vector_to_array("probability")[rough].alias("probability"))


def rf_pixels(px: DataFrame, labelled: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Random-forest probability of foreground from value, local deviation, Gaussian and gradient.

    labelled(pixel, label 0/1) are the training pixels."""
    f = px.join(local_std(px), PIXEL).join(separable(px, "intensity", gaussian_weights(1.0), "smooth").select(*PIXEL, "smooth"), PIXEL).join(gradient_magnitude(px), PIXEL)
    f = _vectors(f, ["intensity", "local_std", "smooth", "gradient"])
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label").fit(f.join(labelled, PIXEL))
    return model.transform(f).select(*PIXEL, vector_to_array("probability")[1].alias("probability"))


def ensemble_probability(px: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean of forest, mixture and the frame-normalised local deviation; foreground from one half on."""
    s = local_std(px)
    top = F.max("local_std").over(W.partitionBy(*FRAME))
    s = s.withColumn("norm", F.coalesce(F.col("local_std") / F.when(top > 0, top), F.lit(0.0))).select(*PIXEL, "norm")
    p = rf_pixels(px, labelled).withColumnRenamed("probability", "rf").join(gmm_pixels(px).withColumnRenamed("probability", "gm"), PIXEL).join(s, PIXEL)
    mean = (F.col("rf") + F.col("gm") + F.col("norm")) / 3
    return p.select(*PIXEL, mean.alias("probability"), (mean >= 0.5).alias("foreground"))


def augment_pairs(px: DataFrame, sigma: float = 6.0, low: float = 0.8, high: float = 1.25, width: int = 8, seed: str = "aug") -> DataFrame:
    """Three variants of every pixel: noise, gamma (one per frame) and horizontal flip.

    Draws are functions of md5(seed, ids), so they are the same in every run: noise is the Box-Muller form of two of them.
    """
    def uniform(*parts: str) -> Column:
        text = F.concat_ws("-", F.lit(seed), *[F.lit(p) if p in ("u", "v", "g") else F.col(p).cast("string") for p in parts])
        return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    noise = F.sqrt(-2 * F.log(uniform("u", *PIXEL))) * F.cos(F.lit(6.283185307179586) * uniform("v", *PIXEL)) * sigma
    gamma = F.lit(low) + (high - low) * uniform("g", *FRAME)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))
    kinds = px.withColumn("variant", F.explode(F.array(F.lit("noise"), F.lit("gamma"), F.lit("flip"))))
    value = F.when(F.col("variant") == "noise", clip(F.col("intensity") + noise)).when(F.col("variant") == "gamma", 255 * F.pow(F.col("intensity") / 255, gamma)).otherwise(F.col("intensity"))
    col = F.when(F.col("variant") == "flip", width - 1 - F.col("col_")).otherwise(F.col("col_"))
    return kinds.select("recording_id", "frame", "variant", "row_", col.alias("col_"), value.alias("intensity"))
