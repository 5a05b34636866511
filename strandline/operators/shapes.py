"""Shape modes: registered contour vectors, PCA, k-means, heterogeneity."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.cascade import frame_range
from strandline.operators.edges import filled_sectors, sector_of
from strandline.operators.masks import FRAME, boundary_pixels


def shape_vectors(px: DataFrame, sectors: int = 50, least_points: int = 10) -> DataFrame:
    """Per frame the median boundary radius in `sectors` directions from the centroid, turned so that the main axis points
    to sector 0 and divided by the mean radius; frames with fewer boundary points are dropped."""
    c = px.groupBy(*FRAME).agg(F.avg("row_").alias("cy"), F.avg("col_").alias("cx"), F.covar_pop("row_", "col_").alias("cov"), F.var_pop("row_").alias("vr"), F.var_pop("col_").alias("vc"))
    c = c.select(*FRAME, "cy", "cx", (0.5 * F.atan2(2 * F.col("cov"), F.col("vc") - F.col("vr"))).alias("turn"))
    edge = boundary_pixels(px).join(c.hint("shuffle_hash"), FRAME)
    dy, dx = F.col("row_") - F.col("cy"), F.col("col_") - F.col("cx")
    ry, rx = dy * F.cos("turn") - dx * F.sin("turn"), dx * F.cos("turn") + dy * F.sin("turn")
    s = edge.select(*FRAME, sector_of(ry, rx, sectors).alias("sector"), F.sqrt(dy * dy + dx * dx).alias("r"))
    radii = s.groupBy(*FRAME, "sector").agg(F.median("r").alias("radius"), F.count("*").alias("n"))
    filled = filled_sectors(radii, sectors, least_points=least_points).where("_most > 0").withColumn("_k", F.filter("_r", lambda x: x.isNotNull()))
    mean = F.aggregate("_k", F.lit(0.0), lambda t, x: t + x) / F.size("_k")
    # The mean is an array's argument, so that it is made once a frame and not once a sector.
    return filled.select(*FRAME, F.zip_with("_r", F.array_repeat(mean, sectors), lambda x, m: x / m).alias("v"))


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.transform("v", lambda x: x.cast("double"))))


def _components(vectors: DataFrame) -> tuple[DataFrame, int]:
    f = _features(vectors)
    n, dims = f.count(), len(f.first()["v"])
    return f, max(1, min(20, n - 1, dims))


def _principal(vectors: DataFrame, most: int = 20):
    """(features, model, directions as columns, mean shape): the principal directions of vectors about their mean, each with its largest element positive.

    Spark adds up one covariance matrix of the points' number squared; the driver holds that and the mean.
    """
    f, k = _components(vectors)
    model = PCA(k=min(k, most), inputCol="features", outputCol="pc").fit(f)
    mean = f.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    pc = model.pc.toArray()
    return f, model, pc * np.where(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])] < 0, -1.0, 1.0), mean


def _scored(f: DataFrame, model, directions: np.ndarray, mean: np.ndarray) -> DataFrame:
    """f with scores: what each vector less the mean shape has of every direction."""
    turn = np.sign((model.pc.toArray() * directions).sum(axis=0))
    at = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(m)).alias("m")) for t, m in zip(turn, mean @ directions)])
    return model.transform(f).withColumn("scores", F.zip_with(vector_to_array("pc"), at, lambda s, a: s * a["t"] - a["m"])).drop("features", "pc")


def shape_pca(vectors: DataFrame) -> DataFrame:
    """Scores of every vector, less the mean shape, on the first min(20, n - 1, dims) principal directions; an empty table gives none."""
    if vectors.isEmpty():
        return vectors.drop("v").withColumn("scores", F.lit(None).cast("array<double>"))
    return _scored(*_principal(vectors)).drop("v")


def shape_components(vectors: DataFrame) -> DataFrame:
    """(component, explained, direction, mean): the principal directions with the share of the variance each explains, and the mean shape."""
    fields = "component int, explained double, direction array<double>, mean array<double>"
    if vectors.isEmpty():
        return vectors.sparkSession.createDataFrame([], fields)
    _, model, directions, mean = _principal(vectors)
    rows = [(k, float(e), directions[:, k].tolist(), mean.tolist()) for k, e in enumerate(model.explainedVariance.toArray())]
    return vectors.sparkSession.createDataFrame(rows, fields)


def shape_modes(vectors: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k-means mode of every vector on its scores; k becomes max(2, n // 2) if n < k, and fewer than five vectors give no rows."""
    n = vectors.count()
    if n < 5:
        return vectors.select("vec_id", F.lit(None).cast("int").alias("mode")).limit(0)
    scored = _scored(*_principal(vectors)).withColumn("features", array_to_vector("scores"))
    model = KMeans(k=k if n >= k else max(2, n // 2), seed=seed, maxIter=100, featuresCol="features", predictionCol="mode").fit(scored)
    return model.transform(scored).select("vec_id", "mode")


def mode_fractions(modes: DataFrame, k: int) -> DataFrame:
    """Count and fraction of every mode 0..k-1, empty ones included."""
    spine = modes.sparkSession.range(k).select(F.col("id").cast("int").alias("mode_id"))
    n = modes.groupBy("mode_id").agg(F.count("*").alias("n"))
    total = modes.agg(F.count("mode_id").alias("total"))
    return spine.join(n, "mode_id", "left").join(total).select("mode_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def shape_heterogeneity(modes: DataFrame, k: int) -> DataFrame:
    """Shannon entropy in bits of the mode fractions, log2 k, and the entropy over max(log2 k, 1)."""
    p = F.col("fraction")
    e = mode_fractions(modes, k).agg((-F.sum(F.when(p > 0, p * F.log2(p)))).alias("entropy"))
    top = F.log2(F.lit(float(k)))
    return e.select(F.lit(k).alias("k"), "entropy", top.alias("max_entropy"), (F.col("entropy") / F.greatest(top, F.lit(1.0))).alias("normalised"))


def frame_modes(modes: DataFrame, frames: DataFrame) -> DataFrame:
    """Mode of every frame 0..last, null where there is no contour."""
    spine = frame_range(frames.select(F.col("vec_id").alias("frame")), 0)
    return spine.join(modes.select(F.col("vec_id").alias("frame"), "mode_id"), "frame", "left")


def eigenshapes(vectors: DataFrame, count: int = 4, amount: float = 0.3) -> DataFrame:
    """(component, point, low, mean, high): mean shape -+ amount times each of the first principal directions."""
    _, _, pc, mean = _principal(vectors, count)
    rows = [(c, i, float(mean[i] - amount * pc[i, c]), float(mean[i]), float(mean[i] + amount * pc[i, c])) for c in range(pc.shape[1]) for i in range(pc.shape[0])]
    return vectors.sparkSession.createDataFrame(rows, "component int, point int, low double, mean double, high double")
