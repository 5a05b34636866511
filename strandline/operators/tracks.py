"""Trajectory operators over track_points(recording_id, track_id, frame, cy, cx): dense frames, null where no object."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandline.functions.primitives import MINUTES, UM_PER_PX, convolve, gaussian_weights

KEYS = ["recording_id", "track_id"]


def along() -> WindowSpec:
    """The frames of a track in order."""
    return W.partitionBy(*KEYS).orderBy("frame")


def px_to_um(points: DataFrame, um_per_px: float = UM_PER_PX) -> DataFrame:
    """Centroids in micrometres."""
    return points.withColumns({"cy": F.col("cy") * um_per_px, "cx": F.col("cx") * um_per_px})


def frame_to_time(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """points with time_min = frame * minutes per frame."""
    return points.withColumn("time_min", F.col("frame") * F.lit(minutes))


def polar_coords(points: DataFrame, y0: float = 0.0, x0: float = 0.0) -> DataFrame:
    """Angle and radius of every point about a centre."""
    return points.withColumns({"angle": F.atan2(F.col("cy") - y0, F.col("cx") - x0), "radius": F.hypot(F.col("cy") - y0, F.col("cx") - x0)})


def valid(points: DataFrame) -> DataFrame:
    return points.where("cy is not null and cx is not null")


def trajectory_origin(points: DataFrame) -> DataFrame:
    """Positions relative to the track's first valid point."""
    start = F.first(F.when(F.col("cy").isNotNull() & F.col("cx").isNotNull(), F.struct("cy", "cx")), ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return points.withColumn("_s", start).select(*KEYS, "frame", (F.col("cy") - F.col("_s.cy")).alias("cy"), (F.col("cx") - F.col("_s.cx")).alias("cx"))


def steps(points: DataFrame) -> DataFrame:
    """Length of the step from every frame to the next; null beside a gap, absent for the last frame."""
    dy, dx = F.lead("cy").over(along()) - F.col("cy"), F.lead("cx").over(along()) - F.col("cx")
    return points.select(*KEYS, "frame", F.sqrt(dy * dy + dx * dx).alias("step"), F.lead("frame").over(along()).alias("_next")).where("_next is not null").drop("_next")


def instantaneous_speed(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """Speed between adjacent frames that both hold a point."""
    return steps(points).select(*KEYS, "frame", (F.col("step") / minutes).alias("speed"))


def mean_speed(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    return instantaneous_speed(points, minutes).groupBy(*KEYS).agg(F.avg("speed").alias("mean_speed"))


def total_distance(points: DataFrame) -> DataFrame:
    return steps(points).groupBy(*KEYS).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_distance"))


def net_displacement(points: DataFrame) -> DataFrame:
    """Distance from first to last valid point, across gaps; null with fewer than two."""
    at = F.struct("frame", "cy", "cx")
    ends = valid(points).groupBy(*KEYS).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
    d = F.hypot(F.col("b.cy") - F.col("a.cy"), F.col("b.cx") - F.col("a.cx"))
    every = points.select(*KEYS).distinct()
    return every.join(ends, KEYS, "left").select(*KEYS, F.when(F.col("n") >= 2, d).alias("net_displacement"))


def persistence_ratio(points: DataFrame) -> DataFrame:
    """Net over total distance; null if the total is 0."""
    joined = total_distance(points).join(net_displacement(points), KEYS)
    return joined.select(*KEYS, F.when(F.col("total_distance") > 0, F.col("net_displacement") / F.col("total_distance")).alias("persistence"))


#: Points of a track up to which lags are summed directly; longer tracks use transforms.
DIRECT = 16_384


def _curves(points: DataFrame, curve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], names: tuple[str, ...]) -> DataFrame:
    """curve (y, x of a track's valid points in order of frame -> lags and figures) of every track.

    A track becomes one row with its points as an array, so rows shuffled are the points themselves, and one Arrow batch holds
    many tracks.
    """
    at = F.sort_array(F.collect_list(F.struct("frame", F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"))))
    rows = valid(points).groupBy(*KEYS).agg(at.alias("_points"))
    fields = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:2]), "lag int", *(f"{n} double" for n in names)])
    schema = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            y, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("cy", "cx"))
            found = [curve(y[i:j], x[i:j]) for i, j in itertools.pairwise(bounds.tolist())]
            of = pa.array(np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found]))
            made = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(made[0].astype(np.int32)), *(pa.array(m.astype(np.float64)) for m in made[1:])], schema=schema)

    return rows.mapInArrow(run, fields)


def lag_sums(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """Sums of a[t] * b[t + lag] over t for the lags 0 to lags - 1, by transforms padded against wrapping round."""
    size = 1 << int(len(a) + lags - 1).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:lags]


def squared_displacements(y: np.ndarray, x: np.ndarray, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, mean, standard error) of squared displacements, lags 1 to n // 2 - 1."""
    n = len(y)
    lags = np.arange(1, max(1, n // 2))
    if n <= direct:
        each = [(y[k:] - y[:-k]) ** 2 + (x[k:] - x[:-k]) ** 2 for k in lags]
        return lags, np.array([d.mean() for d in each]), np.array([d.std() / np.sqrt(len(d)) for d in each])
    y, x, most = y - y.mean(), x - x.mean(), n // 2
    q = y * y + x * x
    dots = lag_sums(y, y, most) + lag_sums(x, x, most)
    count = n - np.arange(most)
    tops, tails = (lambda v: (np.cumsum(v)[n - 1 - np.arange(most)], np.cumsum(v[::-1])[n - 1 - np.arange(most)]))(q)
    mean = (tops + tails - 2 * dots) / count
    tops, tails = (lambda v: (np.cumsum(v)[n - 1 - np.arange(most)], np.cumsum(v[::-1])[n - 1 - np.arange(most)]))(q * q)
    square = tops + tails + 2 * lag_sums(q, q, most) + 4 * (lag_sums(y * y, y * y, most) + lag_sums(x * x, x * x, most) + 2 * lag_sums(y * x, y * x, most))
    square -= 4 * sum(lag_sums(q * v, v, most) + lag_sums(v, q * v, most) for v in (y, x))
    return lags, mean[1:], np.sqrt(np.maximum(square / count - mean**2, 0) / count)[1:]


def msd(points: DataFrame) -> DataFrame:
    """Mean squared displacement and its standard error per lag over valid points, lags 1 to n // 2 - 1.

    Tracks of up to DIRECT points are summed lag by lag; the sums of longer ones are sums of products, which running sums and transforms give for all
    lags in n log n steps (to about twelve digits of the largest squared distance from the track's centre).
    """
    return _curves(points, squared_displacements, ("msd", "sem"))


def turning(y: np.ndarray, x: np.ndarray, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, mean, standard error) of cosines between unit steps, lags 0 to (n - 1) // 2 - 1 (0 at least); lag 0 is 1."""
    m = len(y) - 1
    if m < 2:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    dy, dx = np.diff(y), np.diff(x)
    norm = np.maximum(np.sqrt(dy * dy + dx * dx), 1e-8)
    dy, dx, most = dy / norm, dx / norm, max(1, m // 2)
    lags = np.arange(most)
    if m < direct:
        each = [dy[k:] * dy[:m - k] + dx[k:] * dx[:m - k] for k in lags[1:]]
        return lags, np.array([1.0, *(c.mean() for c in each)]), np.array([0.0, *(c.std() / np.sqrt(len(c)) for c in each)])
    count = m - lags
    mean = (lag_sums(dy, dy, most) + lag_sums(dx, dx, most)) / count
    square = (lag_sums(dy * dy, dy * dy, most) + lag_sums(dx * dx, dx * dx, most) + 2 * lag_sums(dy * dx, dy * dx, most)) / count
    error = np.sqrt(np.maximum(square - mean**2, 0) / count)
    mean[0], error[0] = 1.0, 0.0
    return lags, mean, error


def direction_autocorrelation(points: DataFrame) -> DataFrame:
    """Mean cosine between unit steps at each lag from 0 to min((n - 1) // 2, n - 1) - 1, with its standard error; lag 0 is 1. Sums as in msd."""
    return _curves(points, turning, ("autocorrelation", "sem"))


def msd_diffusion_fit(curve: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """D, alpha and r2 of the line log10 msd = log10 4D + alpha log10 t; (0, 1, 0) with fewer than three points."""
    good = (F.col("lag") > 0) & (F.col("msd") > 0)
    t, y = F.log10(F.when(good, F.col("lag") * minutes)), F.log10(F.when(good, F.col("msd")))
    fit = curve.groupBy(*KEYS).agg(F.count(F.when(good, 1)).alias("n"), F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("at0"), F.regr_r2(y, t).alias("r2"))
    enough = F.col("n") >= 3
    return fit.select(*KEYS, F.when(enough, F.pow(F.lit(10.0), "at0") / 4).otherwise(0.0).alias("d"), F.when(enough, F.col("slope")).otherwise(1.0).alias("alpha"), F.when(enough, F.col("r2")).otherwise(0.0).alias("r_squared"))


def smooth_trajectory(points: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing over valid points, reflected at the ends; frames without a point stay null, short tracks unchanged."""
    numbered = valid(points).select(*KEYS, "frame", "cy", "cx", (F.row_number().over(along()) - 1).alias("idx"), F.count("*").over(W.partitionBy(*KEYS)).alias("n"))
    smooth = convolve(numbered.where("n >= 3"), KEYS, "idx", ["cy", "cx"], gaussian_weights(sigma)).select(*KEYS, "idx", F.col("cy").alias("sy"), F.col("cx").alias("sx"))
    placed = numbered.join(smooth, [*KEYS, "idx"], "left").select(*KEYS, "frame", F.coalesce("sy", "cy").alias("cy"), F.coalesce("sx", "cx").alias("cx"))
    return points.select(*KEYS, "frame").join(placed, [*KEYS, "frame"], "left")


def _rounded(x: str | Column, n: int = 6) -> Column:
    return F.round(x, n)


def analyze_recording(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """One row per track: frames, valid points, mean speed, total and net distance, persistence."""
    s = steps(points).groupBy(*KEYS).agg((F.avg("step") / minutes).alias("mean_speed"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_distance"))
    at = F.when(F.col("cy").isNotNull(), F.struct("frame", "cy", "cx"))
    ends = points.groupBy(*KEYS).agg(F.count("*").alias("n_frames"), F.count("cy").alias("n_valid"), F.min(at).alias("a"), F.max(at).alias("b"))
    net = F.when(F.col("n_valid") >= 2, F.hypot(F.col("b.cy") - F.col("a.cy"), F.col("b.cx") - F.col("a.cx")))
    joined = ends.join(s, KEYS, "left").withColumn("net_displacement", net).withColumn("total_distance", F.coalesce("total_distance", F.lit(0.0)))
    return joined.select(*KEYS, "n_frames", "n_valid", "mean_speed", "total_distance", "net_displacement",
                         F.when(F.col("total_distance") > 0, F.col("net_displacement") / F.col("total_distance")).alias("persistence"))


def series_by_cell(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """Long table of every track's speed with the mean and mean -+ std band over the tracks of a recording's frame."""
    speed = instantaneous_speed(points, minutes)
    over = W.partitionBy("recording_id", "frame")
    m, s = F.avg("speed").over(over), F.stddev_pop("speed").over(over)
    return speed.withColumns({"mean": m, "low": m - s, "high": m + s})


def cell_series(points: DataFrame, um: float = UM_PER_PX, minutes: float = MINUTES) -> DataFrame:
    """(metric, recording_id, track_id, frame, value, mean, low, high): every track's speed, path (y and x from its first point, in micrometres) and, where
    points has area_px, area, each with the mean and mean -+ std band over the tracks of a recording's frame. Frames without a value have no row.
    """
    path = trajectory_origin(points).select(*KEYS, "frame", (F.col("cy") * um).alias("path_y_um"), (F.col("cx") * um).alias("path_x_um"))
    parts = [path.unpivot([*KEYS, "frame"], ["path_y_um", "path_x_um"], "metric", "value"), steps(points).select(*KEYS, "frame", F.lit("speed_um_min").alias("metric"), (F.col("step") * um / minutes).alias("value"))]
    if "area_px" in points.columns:
        parts.append(points.select(*KEYS, "frame", F.lit("area_um2").alias("metric"), (F.col("area_px") * um * um).alias("value")))
    over = W.partitionBy("metric", "recording_id", "frame")
    m, s = F.avg("value").over(over), F.stddev_pop("value").over(over)
    every = functools.reduce(DataFrame.unionByName, parts).where("value is not null")
    return every.withColumns({"mean": m, "low": m - s, "high": m + s}).select("metric", *KEYS, "frame", "value", "mean", "low", "high")


def track_summary(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """cell_id (1-based within the recording), frames tracked, first frame and mean speed of every track."""
    speed = mean_speed(points, minutes)
    base = valid(points).groupBy(*KEYS).agg(F.count("*").alias("frames_tracked"), F.min("frame").alias("first_frame"))
    cell = F.dense_rank().over(W.partitionBy("recording_id").orderBy("track_id"))
    return base.join(speed, KEYS, "left").withColumn("cell_id", cell)


def per_cell_timeseries(points: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """frame x (time, centroid, speed) of every track; the speed stands at the first of its two frames."""
    return frame_to_time(points, minutes).join(instantaneous_speed(points, minutes), [*KEYS, "frame"], "left").select(*KEYS, "frame", "time_min", "cy", "cx", "speed")
