"""Edge dynamics: polar sectors of object boundaries and the velocity kymograph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.primitives import MINUTES, UM_PER_PX, convolve, fill_linear, frame_spine, gaussian_weights, reflected
from strandline.functions.quantiles import exact_quantiles
from strandline.operators.masks import FRAME, boundary_pixels

SECTOR = [*FRAME, "sector"]


def sector_of(dy: Column, dx: Column, n: int) -> Column:
    """Sector whose centre -pi + i 2pi/n is nearest in angle, wrapping at -pi (a hair is added so that edges fall one way)."""
    width = 2 * math.pi / n
    return F.pmod(F.floor((F.atan2(dy, dx) + F.lit(math.pi + width / 2 + 1e-9)) / F.lit(width)), F.lit(n)).cast("int")


def centroids(px: DataFrame) -> DataFrame:
    return px.groupBy(*FRAME).agg(F.avg("row_").alias("cy"), F.avg("col_").alias("cx"))


def polar_sectors(px: DataFrame, n: int = 72, centre: DataFrame | None = None) -> DataFrame:
    """Median boundary radius per frame and sector about the centroid, with the number of boundary pixels."""
    c = centroids(px) if centre is None else centre
    edge = boundary_pixels(px).select(*FRAME, "row_", "col_").join(c.hint("shuffle_hash"), FRAME)
    dy, dx = F.col("row_") - F.col("cy"), F.col("col_") - F.col("cx")
    return edge.select(*FRAME, sector_of(dy, dx, n).alias("sector"), F.sqrt(dy * dy + dx * dx).alias("r")).groupBy(*SECTOR).agg(F.median("r").alias("radius"), F.count("*").alias("n"))


def filled_sectors(sectors: DataFrame, n: int = 72, keys: list[str] = FRAME, least_points: int = 0) -> DataFrame:
    """(keys, _r, _most), _r the array of a key's n radii, filled as fill_sector_gaps says, _most the largest; keys with fewer than least_points points (column n) are left out.

    The known sectors in order are laid out stretch by stretch, each from its radius up to the next one's, so no sector is sent to its neighbours.
    """
    entries = F.sort_array(F.collect_list(F.struct("sector", "radius"))).alias("_all")
    points = [F.sum("n").alias("_points")] if least_points else []
    known = sectors.groupBy(*keys).agg(entries, F.max("radius").alias("_most"), *points)
    if least_points:
        known = known.where(F.col("_points") >= least_points)
    known = known.withColumn("_e", F.filter("_all", lambda e: e["radius"].isNotNull())).withColumn("_k", F.size("_e"))
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def stretch(e: Column, i: Column) -> Column:
        to = F.get("_e", i + 1)
        line = lambda s: e["radius"] + (to["radius"] - e["radius"]) * ((s - e["sector"]) / (to["sector"] - e["sector"]))
        return F.when(to.isNull(), F.array_repeat(e["radius"], F.lit(n) - e["sector"])).otherwise(F.transform(F.sequence(e["sector"], to["sector"] - 1), line))

    first = F.get("_e", F.lit(0))
    whole = F.concat(F.array_repeat(first["radius"], first["sector"]), F.flatten(F.transform("_e", stretch)))
    few = F.transform(every, lambda s: F.get(F.filter("_e", lambda e: e["sector"] == s), F.lit(0))["radius"])
    return known.select(*keys, F.when(F.col("_k") > 2, whole).otherwise(few).alias("_r"), "_most")


def fill_sector_gaps(sectors: DataFrame, n: int = 72, keys: list[str] = FRAME) -> DataFrame:
    """Every sector of every frame; empty ones on the line between valid neighbours, ends clamped, only with more than two."""
    return filled_sectors(sectors, n, keys).select(*keys, F.posexplode("_r").alias("sector", "radius"))


# Weights of the quadratic over five points, in 35ths.
TAPS = ((-2, -3), (-1, 12), (0, 17), (1, 12), (2, -3))


def smoothed_sectors(rows: DataFrame, n: int = 72, keys: list[str] = FRAME) -> DataFrame:
    """(keys, _s), _s the array of a key's radii _r (n of them) after circular five-point quadratic smoothing; nulls are left out of the sums.

    A key's radii are smoothed as one array of n, so that no row is sent to its neighbours.
    """
    def smooth(_: Column, i: Column) -> Column:
        near = [F.get("_r", F.pmod(i + o, F.lit(n))) * (w / 35.0) for o, w in TAPS]
        return F.when(F.coalesce(*near).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in near[1:]), F.coalesce(near[0], F.lit(0.0))))

    return rows.select(*keys, F.transform("_r", smooth).alias("_s"))


def smooth_sectors(sectors: DataFrame, n: int = 72, keys: list[str] = FRAME) -> DataFrame:
    """smoothed_sectors of dense sectors (0 to n - 1 of every key), as one row a sector."""
    rows = sectors.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("sector", "radius"))), lambda s: s["radius"]).alias("_r"))
    return smoothed_sectors(rows, n, keys).select(*keys, F.posexplode("_s").alias("sector", "radius"))


def pair_velocities(px: DataFrame, n: int = 72, um: float = UM_PER_PX, minutes: float = MINUTES) -> DataFrame:
    """(recording_id, frame, _v), _v the array of n velocities between a frame and the next, radii of both taken about the midpoint of the two centroids.

    The two midpoints of a frame come to its edge pixels, which stay where they are; only smoothed arrays, two a frame, are sent to their pair.
    """
    c = centroids(px)
    nxt = c.select("recording_id", (F.col("frame") - 1).alias("frame"), F.col("cy").alias("dy"), F.col("cx").alias("dx"))
    pairs = c.join(nxt.hint("merge"), FRAME).select("recording_id", F.col("frame").alias("pair"), ((F.col("cy") + F.col("dy")) / 2).alias("my"), ((F.col("cx") + F.col("dx")) / 2).alias("mx"))
    sides = [pairs.select("recording_id", (F.col("pair") + k).alias("frame"), F.lit(k).alias("side"), "my", "mx") for k in (0, 1)]
    edge = boundary_pixels(px).join(sides[0].unionByName(sides[1]).hint("shuffle_hash"), FRAME)
    dy, dx = F.col("row_") - F.col("my"), F.col("col_") - F.col("mx")
    keys = [*FRAME, "side"]
    radii = edge.select(*keys, sector_of(dy, dx, n).alias("sector"), F.sqrt(dy * dy + dx * dx).alias("r")).groupBy(*keys, "sector").agg(F.median("r").alias("radius"))
    radii = smoothed_sectors(filled_sectors(radii, n, keys), n, keys)
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("_s")))
    both = radii.groupBy("recording_id", (F.col("frame") - F.col("side")).alias("frame")).agg(at(0).alias("_r0"), at(1).alias("_r1"))
    return both.select(*FRAME, F.zip_with("_r1", "_r0", lambda b, a: (b - a) * um / minutes).alias("_v"))


def edge_velocity_pair(px: DataFrame, n: int = 72, um: float = UM_PER_PX, minutes: float = MINUTES) -> DataFrame:
    """Velocity per sector between a frame and the next (pair_velocities)."""
    return pair_velocities(px, n, um, minutes).select(*FRAME, F.posexplode("_v").alias("sector", "velocity"))


#: Frames of a recording that are smoothed in one group, apart from those near its ends.
BLOCK = 512


def edge_kymograph(px: DataFrame, n: int = 72, sigma: float = 1.0, um: float = UM_PER_PX, minutes: float = MINUTES) -> DataFrame:
    """Frame pairs x sectors, null where either frame is empty; smoothed in time with nulls as 0, which are then restored.

    A pair is one row with an array of sectors. Recordings are cut into blocks of frames, and pairs within the kernel's reach of a block
    are copied to it; reflected at a recording's ends, an index is never farther from its row than the one it stands for. Missing pairs add nothing.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    spine = frame_spine(px, ["recording_id"])
    size = spine.groupBy("recording_id").agg(F.max("frame").alias("_m"))
    v = pair_velocities(px, n, um, minutes).join(size, "recording_id")
    block = lambda f: F.floor(f / BLOCK)
    v = v.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("frame") - r), block(F.col("frame")), block(F.col("frame") + r)))))
    near = F.collect_list(F.struct("frame", "_v")).over(W.partitionBy("recording_id", "_block").orderBy("frame").rangeBetween(-r, r))
    v = v.withColumn("_near", near).where(F.col("_block") == block(F.col("frame")))
    weight = lambda j: sum((F.when(reflected(F.col("frame") + (k - r), F.col("_m")) == j, w).otherwise(0.0) for k, w in enumerate(weights[1:], 1)), F.when(reflected(F.col("frame") - r, F.col("_m")) == j, weights[0]).otherwise(0.0))
    # The weighted pairs are the argument of the sum, so that they are made once a row and not once a sector.
    weighted = F.transform("_near", lambda x: F.struct(weight(x["frame"]).alias("w"), x["_v"].alias("v")))
    total = F.aggregate(weighted, F.array_repeat(F.lit(0.0), n), lambda t, x: F.zip_with(t, x["v"], lambda a, b: a + x["w"] * F.coalesce(b, F.lit(0.0))))
    v = v.select(*FRAME, F.zip_with("_v", total, lambda raw, t: F.when(raw.isNotNull(), t)).alias("_k"))
    pairs = spine.join(size, "recording_id").where("frame < _m").drop("_m")
    dense = pairs.join(v.hint("merge"), FRAME, "left")
    return dense.select(*FRAME, F.posexplode(F.coalesce("_k", F.array_repeat(F.lit(None).cast("double"), n))).alias("sector", "velocity"))


def edge_summary(kymograph: DataFrame) -> DataFrame:
    """Protrusion and retraction figures per recording; null without data, 0 for an absent sign."""
    v = F.col("velocity")
    zero = lambda c: F.when(F.count("velocity") > 0, F.coalesce(c, F.lit(0.0)))
    return kymograph.groupBy("recording_id").agg(
        zero(F.avg(F.when(v > 0, v))).alias("mean_protrusion_velocity"), zero(F.avg(F.when(v < 0, v))).alias("mean_retraction_velocity"),
        (F.count(F.when(v > 0, 1)) / F.expr("nullif(count(velocity), 0)")).alias("protrusion_fraction"), F.avg(v).alias("net_velocity"),
        zero(F.max(F.when(v > 0, v))).alias("max_protrusion"), zero(F.min(F.when(v < 0, v))).alias("max_retraction"))


def smooth_radii_over_time(sectors: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Per sector: missing frames on the line between valid ones (ends clamped, two valid at least), then Gaussian over frames."""
    keys = ["recording_id", "sector"]
    spine = frame_spine(sectors, ["recording_id"]).join(sectors.select(*keys).distinct(), "recording_id")
    s = spine.join(sectors.select(*SECTOR, "radius").hint("merge"), SECTOR, "left").withColumn("_k", F.count("radius").over(W.partitionBy(*keys)))
    filled = fill_linear(s.where("_k >= 2"), keys, "frame", "radius", "_f").select(*SECTOR, F.col("_f").alias("radius"))
    return convolve(filled, keys, "frame", ["radius"], gaussian_weights(sigma))


def kymograph_limits(kymograph: DataFrame) -> DataFrame:
    """Colour range: 95th percentile and maximum of |velocity|."""
    speed = kymograph.withColumn("_speed", F.abs("velocity"))
    return exact_quantiles(speed, ["recording_id"], "_speed", {"p95": 0.95, "max_abs": 1.0})
