"""Operators over mask tables: mask_px(recording_id, frame, label, row_, col_), foreground rows only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.graph import connected_components as graph_components
from strandline.functions.primitives import UM_PER_PX, frame_spine
from strandline.functions.staging import staged
from strandline.operators.words import FRAME, OBJECT, Words, by_object, edge_columns, overlapping, pixel_words


def pixel_runs(px: DataFrame) -> DataFrame:
    """Horizontal runs of foreground: recording_id, frame, row_, c0, c1 (inclusive)."""
    line = W.partitionBy(*FRAME, "row_").orderBy("col_")
    islands = px.select(*FRAME, "row_", "col_").distinct().withColumn("_k", F.col("col_") - F.row_number().over(line))
    return islands.groupBy(*FRAME, "row_", "_k").agg(F.min("col_").alias("c0"), F.max("col_").alias("c1")).drop("_k")


def _spans(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row that each element of an array column belongs to, and the elements' fields."""
    lists = batch.column(name)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _rooted(reach: int):
    """Runs with the first run of their component, of many frames' bands at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, (row, c0, c1) = _spans(batch, "runs", ("row_", "c0", "c1"))
            above, below = overlapping(owner.astype(np.int64) * (1 << 32) + row, c0, c1, reach)
            root, before = np.arange(len(row)), None
            while before is None or (root != before).any():
                before, least = root.copy(), np.minimum(root[above], root[below])
                for end in (above, below):
                    np.minimum.at(root, root[end], least)
                    np.minimum.at(root, end, least)
                root = root[root]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in FRAME), *(pa.array(v, pa.int32()) for v in (row, c0, c1, row[root], c0[root]))], [*FRAME, "row_", "c0", "c1", "root_row", "root_c0"])
    return run


def component_runs(px: DataFrame, neighbours: int = 8, band: int = 256) -> DataFrame:
    """pixel_runs with labels 1..k per frame, numbered by each component's first pixel in row-major order.

    Frames are cut into bands of rows. Within a band, components are found over the arrays of its runs; those that touch across
    bands are joined as a graph of components, so no task holds more than the runs of a band.
    """
    reach = 1 if neighbours == 8 else 0
    runs = pixel_runs(px).select(*FRAME, *(F.col(c).cast("int").alias(c) for c in ("row_", "c0", "c1")))
    bands = runs.groupBy(*FRAME, F.floor(F.col("row_") / band).alias("_band")).agg(F.sort_array(F.collect_list(F.struct("row_", "c0", "c1"))).alias("runs"))
    kinds = dict(px.dtypes)
    rooted = staged(bands.mapInArrow(_rooted(reach), ", ".join([*(f"{c} {kinds[c]}" for c in FRAME), "row_ int, c0 int, c1 int, root_row int, root_c0 int"])), "runs")
    rooted = rooted.select(*FRAME, "row_", "c0", "c1", F.struct(*FRAME, "root_row", "root_c0").alias("node"))
    low = rooted.where(F.pmod("row_", F.lit(band)) == band - 1)
    high = rooted.where(F.pmod("row_", F.lit(band)) == 0).select(*FRAME, (F.col("row_") - 1).alias("row_"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("other"))
    touching = low.join(high.hint("merge"), [*FRAME, "row_"]).where((F.col("d0") <= F.col("c1") + reach) & (F.col("d1") >= F.col("c0") - reach))
    parts = graph_components(touching.select("node", "other"), "node", "other")
    whole = rooted.join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return whole.select(*FRAME, F.dense_rank().over(W.partitionBy(*FRAME).orderBy("root")).alias("label"), "row_", "c0", "c1")


def connected_components(px: DataFrame, neighbours: int = 8) -> DataFrame:
    """mask_px with labels 1..k per frame, numbered by each component's first pixel in row-major order (component_runs)."""
    return component_runs(px, neighbours).select(*OBJECT, "row_", F.explode(F.sequence("c0", "c1")).alias("col_"))


def object_table(px: DataFrame, min_area: int = 1) -> DataFrame:
    """Centroid and area of every object with at least min_area pixels."""
    return px.groupBy(*OBJECT).agg(F.avg("row_").alias("cy"), F.avg("col_").alias("cx"), F.count("*").alias("area_px")).where(F.col("area_px") >= min_area)


def largest_component(px: DataFrame, min_area: int = 1) -> DataFrame:
    """Only the largest object of every frame (lowest label among equals)."""
    best = object_table(px, min_area).withColumn("_r", F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("area_px"), "label"))).where("_r = 1")
    # Two inequalities: an equality would become a key of the join and deal all pixels by object. A task's frames, one row each, are hashed, so that its pixels are not sorted.
    return px.join(best.select(*FRAME, F.col("label").alias("_best")).hint("shuffle_hash"), FRAME).where("label <= _best and label >= _best").select(*px.columns)


def min_area_filter(px: DataFrame, min_area: int = 50) -> DataFrame:
    """Objects of at least min_area pixels, renumbered 1..k per frame in the order of the old labels."""
    kept = object_table(px, min_area).select(*OBJECT, F.dense_rank().over(W.partitionBy(*FRAME).orderBy("label")).alias("new_label"))
    return px.join(kept, OBJECT).select(*FRAME, F.col("new_label").alias("label"), "row_", "col_")


def centroid_series(px: DataFrame) -> DataFrame:
    """Centroid of the foreground per frame on the dense frame spine; null for empty frames."""
    c = px.groupBy(*FRAME).agg(F.avg("row_").alias("cy"), F.avg("col_").alias("cx"))
    return frame_spine(px, ["recording_id"]).join(c, FRAME, "left")


def object_bbox(px: DataFrame, pad: int = 5, height: int = 64, width: int = 64, per_frame: bool = True) -> DataFrame:
    """Padded, clipped, half-open bounding box per frame, or of all frames of a recording."""
    keys = FRAME if per_frame else ["recording_id"]
    return px.groupBy(*keys).agg(
        F.greatest(F.min("row_") - pad, F.lit(0)).alias("r0"), F.least(F.max("row_") + 1 + pad, F.lit(height)).alias("r1"),
        F.greatest(F.min("col_") - pad, F.lit(0)).alias("c0"), F.least(F.max("col_") + 1 + pad, F.lit(width)).alias("c1"))


def crop(px: DataFrame, box: DataFrame) -> DataFrame:
    """Rows inside their recording's box, in the box's coordinates, with the offsets needed to paste them back."""
    inside = px.join(box, "recording_id").where("row_ >= r0 and row_ < r1 and col_ >= c0 and col_ < c1")
    return inside.select(*OBJECT, (F.col("row_") - F.col("r0")).alias("row_"), (F.col("col_") - F.col("c0")).alias("col_"), "r0", "c0")


def paste_back(cropped: DataFrame) -> DataFrame:
    return cropped.select(*OBJECT, (F.col("row_") + F.col("r0")).alias("row_"), (F.col("col_") + F.col("c0")).alias("col_"))


def _pixels_of(px: DataFrame, part: Callable[[Words], np.ndarray]) -> DataFrame:
    """Pixels that part picks of the words of every object."""
    kinds = dict(px.dtypes)
    return by_object(px, edge_columns(part), "row_ int, col_ int").select(*OBJECT, *(F.col(c).cast(kinds[c]).alias(c) for c in ("row_", "col_")))


def edge_pixels(px: DataFrame) -> DataFrame:
    """Pixels with a 4-neighbour that is not of their object, edges of holes included."""
    return _pixels_of(px, Words.edge)


def holes(px: DataFrame) -> DataFrame:
    """(recording_id, frame, label, row_, c0, c1): the runs of background that an object encloses (Words.holes)."""
    def runs(words: Words) -> list[np.ndarray]:
        owner, *values = words.holes()
        return [owner, *(v.astype(np.int32) for v in values)]

    return by_object(px, runs, "row_ int, c0 int, c1 int")


def boundary_pixels(px: DataFrame) -> DataFrame:
    """Pixels of an object's outer boundary: those with a 4-neighbour outside of it that lies in none of its holes.

    So a ring and its filled disc have one boundary. Pixels are grouped as bits of words, without sorting them.
    """
    return _pixels_of(px, Words.outer)


HULL = "array<struct<y:bigint,x:bigint>>"


def _chain(points: list) -> list:
    out = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
            out.pop()
        out.append(p)
    return out


def hull_points(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, in order; those of a union follow from those of its parts."""
    points = sorted(set(points))
    return points if len(points) < 3 else _chain(points)[:-1] + _chain(points[::-1])[:-1]


def lattice_points(hull: list[tuple[int, int]]) -> int:
    """Pixel centres in a closed hull whose coordinates are twice those of pixels."""
    points = sorted(hull)
    low, high = _chain(points), _chain(points[::-1])[::-1]
    y = np.arange(-(-points[0][0] // 2), points[-1][0] // 2 + 1) * 2
    one, two = (np.interp(y, [p[0] for p in side], [p[1] for p in side]) for side in (low, high))
    left, right = np.minimum(one, two), np.maximum(one, two)
    return int((np.floor(right / 2 + 1e-9) - np.ceil(left / 2 - 1e-9) + 1).sum())


def convex_areas(px: DataFrame, band: int = 256) -> DataFrame:
    """(recording_id, frame, label, convex): pixels whose centre lies in the convex hull of the object's pixel edges' midpoints.

    Of a row only its first and last pixel enter, counted before the shuffle. Hulls of bands of rows merge into that of the object by
    their corners, so no task holds more than a band's rows or an object's corners.
    """
    @F.pandas_udf(HULL)
    def hull(points: pd.Series) -> pd.Series:
        return pd.Series([[{"y": y, "x": x} for y, x in hull_points([(p["y"], p["x"]) for p in ps])] for ps in points])

    @F.pandas_udf("bigint")
    def size(points: pd.Series) -> pd.Series:
        return pd.Series([lattice_points(hull_points([(p["y"], p["x"]) for p in ps])) for ps in points], dtype="int64")

    ends = px.groupBy(*OBJECT, "row_").agg(F.min("col_").cast("long").alias("a"), F.max("col_").cast("long").alias("b"))
    y, a, b = 2 * F.col("row_").cast("long"), 2 * F.col("a"), 2 * F.col("b")
    at = lambda r, c: F.struct(r.alias("y"), c.alias("x"))
    ends = ends.select(*OBJECT, F.floor(F.col("row_") / band).alias("_band"), F.array(at(y, a - 1), at(y, b + 1), at(y - 1, a), at(y - 1, b), at(y + 1, a), at(y + 1, b)).alias("p"))
    bands = ends.groupBy(*OBJECT, "_band").agg(F.flatten(F.collect_list("p")).alias("p")).withColumn("p", hull("p"))
    return bands.groupBy(*OBJECT).agg(F.flatten(F.collect_list("p")).alias("p")).select(*OBJECT, size("p").alias("convex"))


def shape_descriptors(px: DataFrame, um: float = UM_PER_PX) -> DataFrame:
    """area_um2, perimeter_um, circularity, solidity, aspect_ratio (bbox width / height) and eccentricity of every object.

    The perimeter is the length of the chain of edge pixels, those of holes too: 1 for neighbours in a row or column, the root of 2 for
    diagonal ones. Solidity is the area over that of the convex hull (convex_areas). Eccentricity comes from the eigenvalues of
    the pixel covariance (each pixel a unit square). The circularity of an object without length is null.
    """
    sides = px.groupBy(*OBJECT).agg(
        F.count("*").alias("n"), (F.max("col_") - F.min("col_") + 1).alias("w"), (F.max("row_") - F.min("row_") + 1).alias("h"),
        (F.var_pop("row_") + F.lit(1 / 12)).alias("vr"), (F.var_pop("col_") + F.lit(1 / 12)).alias("vc"), F.covar_pop("row_", "col_").alias("cov"))
    s = sides.join(chain_length(px), OBJECT).join(convex_areas(px), OBJECT)
    half, spread = (F.col("vr") + F.col("vc")) / 2, F.sqrt(((F.col("vr") - F.col("vc")) / 2) ** 2 + F.col("cov") ** 2)
    area, perimeter = F.col("n") * um * um, F.col("length") * um
    return s.select(*OBJECT, area.alias("area_um2"), perimeter.alias("perimeter_um"), F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).alias("circularity"),
                    (F.col("n") / F.col("convex")).alias("solidity"), (F.col("w") / F.col("h")).alias("aspect_ratio"), F.sqrt(1 - (half - spread) / (half + spread)).alias("eccentricity"))


def chain_length(px: DataFrame) -> DataFrame:
    """Length of every object's edge chain (Words.chain)."""
    return by_object(px, lambda words: [np.arange(words.size), words.chain()], "length double")


def shape_timeseries(px: DataFrame, um: float = UM_PER_PX) -> DataFrame:
    """Descriptors of the largest object on the dense frame spine; null for empty frames."""
    one = largest_component(px)
    return frame_spine(px, ["recording_id"]).join(shape_descriptors(one, um).drop("label"), FRAME, "left")


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of two foregrounds per frame; 0 for an empty union."""
    a, b = (x.select(*FRAME, "row_", "col_").distinct() for x in (a, b))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), [*FRAME, "row_", "col_"], "full_outer")
    return both.groupBy(*FRAME).agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.count("*")).alias("iou"))


def consecutive_iou(px: DataFrame) -> DataFrame:
    """IoU of every frame with the next on the spine (0 beside an empty frame), and whether both hold pixels.

    Words of one row of a frame and the next meet in an equi-join and count the pixels they share; no pixel is shuffled by its place, and none is sorted.
    """
    words = pixel_words(px, FRAME)
    nxt = words.select("recording_id", (F.col("frame") - 1).alias("frame"), "row_", "word", F.col("bits").alias("next"))
    shared = words.join(nxt.hint("merge"), [*FRAME, "row_", "word"]).groupBy(*FRAME).agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("next")))).alias("both"))
    sizes = words.groupBy(*FRAME).agg(F.sum(F.bit_count("bits")).alias("n"))
    s = frame_spine(px, ["recording_id"]).join(sizes.join(shared.hint("merge"), FRAME, "left").hint("merge"), FRAME, "left").fillna(0, ["n", "both"])
    along = W.partitionBy("recording_id").orderBy("frame")
    s = s.withColumn("m", F.lead("n").over(along)).where("m is not null")
    union = F.col("n") + F.col("m") - F.col("both")
    return s.select(*FRAME, F.when(union > 0, F.col("both") / union).otherwise(0.0).alias("iou"), ((F.col("n") > 0) & (F.col("m") > 0)).alias("filled"))


def resolve_overlaps(px: DataFrame) -> DataFrame:
    """Every pixel goes to the lowest label that claims it."""
    return px.groupBy(*FRAME, "row_", "col_").agg(F.min("label").alias("label"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Foreground of either source in frames where the first has any."""
    pixels = a.select(*FRAME, "row_", "col_").union(b.select(*FRAME, "row_", "col_")).distinct()
    return pixels.join(a.select(*FRAME).distinct(), FRAME, "left_semi")


def mask_union_per_object(a: DataFrame, b: DataFrame, pad: int = 20, tile: int = 64) -> DataFrame:
    """Each object of a joined with the pixels of b inside its padded box; lowest label wins.

    A box meets pixels on the squares of `tile` pixels that it touches, so a frame of many objects is no product of its boxes and pixels.
    """
    boxes = a.groupBy(*OBJECT).agg((F.min("row_") - pad).alias("r0"), (F.max("row_") + pad).alias("r1"), (F.min("col_") - pad).alias("c0"), (F.max("col_") + pad).alias("c1"))
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    boxes = boxes.withColumn("ty", tiles("r0", "r1")).withColumn("tx", tiles("c0", "c1"))
    pixels = b.select(*FRAME, "row_", "col_").distinct().withColumn("ty", F.floor(F.col("row_") / tile)).withColumn("tx", F.floor(F.col("col_") / tile))
    near = pixels.join(boxes, [*FRAME, "ty", "tx"]).where("row_ between r0 and r1 and col_ between c0 and c1").select(*OBJECT, "row_", "col_")
    return resolve_overlaps(a.select(*OBJECT, "row_", "col_").union(near))


def best_candidate_by_iou(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """Per frame the candidate (column candidate) of highest IoU with the reference, lowest name among equals."""
    c = candidates.select(*FRAME, "candidate", "row_", "col_").distinct()
    r = reference.select(*FRAME, "row_", "col_").distinct().withColumn("ref", F.lit(1))
    hits = c.join(r, [*FRAME, "row_", "col_"], "left").groupBy(*FRAME, "candidate").agg(F.count("*").alias("n"), F.count("ref").alias("both"))
    size = r.groupBy(*FRAME).agg(F.count("*").alias("m"))
    iou = hits.join(size, FRAME, "left").fillna(0, ["m"]).withColumn("iou", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    return iou.withColumn("_r", F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("iou"), "candidate"))).where("_r = 1").select(*FRAME, "candidate", "iou")


def best_overlap_component(components: DataFrame, seed: DataFrame) -> DataFrame:
    """Per frame of the seed the component that overlaps it most (lowest label among equals); null label keeps the seed."""
    hits = components.join(seed.select(*FRAME, "row_", "col_").distinct().hint("merge"), [*FRAME, "row_", "col_"]).groupBy(*OBJECT).agg(F.count("*").alias("overlap"))
    best = hits.withColumn("_r", F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("overlap"), "label"))).where("_r = 1").drop("_r")
    return seed.select(*FRAME).distinct().join(best.hint("merge"), FRAME, "left")


def tiles(rows: int, cols: int, height: int, width: int, overlap: int) -> list[tuple]:
    """(tile, inner r0, r1, c0, c1, outer r0, r1, c0, c1), half-open."""
    out = []
    for i in range(rows):
        for j in range(cols):
            r0, r1, c0, c1 = i * height // rows, (i + 1) * height // rows, j * width // cols, (j + 1) * width // cols
            out.append((i * cols + j, r0, r1, c0, c1, max(0, r0 - overlap), min(height, r1 + overlap), max(0, c0 - overlap), min(width, c1 + overlap)))
    return out


def tile_assign(px: DataFrame, grid: list[tuple]) -> DataFrame:
    """Every pixel in each tile whose outer box holds it, and whether it lies in the inner one. The grid is a literal array."""
    names = ("tile", "r0", "r1", "c0", "c1", "or0", "or1", "oc0", "oc1")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t)]) for t in grid])
    t = px.withColumn("_t", F.explode(F.filter(table, lambda t: (F.col("row_") >= t["or0"]) & (F.col("row_") < t["or1"]) & (F.col("col_") >= t["oc0"]) & (F.col("col_") < t["oc1"]))))
    inner = (F.col("row_") >= F.col("_t.r0")) & (F.col("row_") < F.col("_t.r1")) & (F.col("col_") >= F.col("_t.c0")) & (F.col("col_") < F.col("_t.c1"))
    return t.select(*OBJECT, "row_", "col_", F.col("_t.tile").alias("tile"), inner.alias("inner"))


def tile_merge(assigned: DataFrame, min_area: int = 20) -> DataFrame:
    """Objects restricted to their tile's inner region, of min_area pixels there, renumbered over (tile, label) per frame."""
    inner = assigned.where("inner")
    kept = inner.groupBy(*FRAME, "tile", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_area)
    kept = kept.withColumn("new_label", F.dense_rank().over(W.partitionBy(*FRAME).orderBy("tile", "label"))).drop("n")
    return inner.join(kept, [*FRAME, "tile", "label"]).select(*FRAME, F.col("new_label").alias("label"), "row_", "col_")


def cell_counts(objects: DataFrame) -> DataFrame:
    """Smallest, largest and mean number of objects per occupied frame of a recording."""
    per = objects.groupBy(*FRAME).agg(F.count_distinct("label").alias("n"))
    return per.groupBy("recording_id").agg(F.min("n").alias("min_cells"), F.max("n").alias("max_cells"), F.avg("n").alias("mean_cells"))


def sample_frames(frames: DataFrame, k: int = 10) -> DataFrame:
    """min(k, n) frames spread evenly over 0..n-1 of every recording (n = last frame + 1), both ends included."""
    n = frames.groupBy("recording_id").agg((F.max("frame") + 1).alias("n")).withColumn("k", F.least("n", F.lit(k)))
    i = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = F.when(F.col("k") > 1, F.floor(F.col("i") * (F.col("n") - 1) / (F.col("k") - 1))).otherwise(0)
    return i.select("recording_id", at.cast("int").alias("frame")).distinct()


def scan_cell_count(objects: DataFrame, k: int = 10, min_area: int = 500) -> DataFrame:
    """Largest number of objects of min_area pixels over sampled frames."""
    seen = objects.join(sample_frames(objects, k), FRAME, "left_semi").where(F.col("area_px") >= min_area)
    return seen.groupBy(*FRAME).count().groupBy("recording_id").agg(F.max("count").alias("max_cells"))


def top_n_objects(objects: DataFrame, n: int = 3) -> DataFrame:
    """The n largest objects of every frame; all for n = 0."""
    if not n:
        return objects
    return objects.withColumn("_r", F.row_number().over(W.partitionBy(*FRAME).orderBy(F.desc("area_px"), "label"))).where(F.col("_r") <= n).drop("_r")


def frame_status(spine: DataFrame, filled: DataFrame, missed: DataFrame) -> DataFrame:
    """0 missed, 1 detected, 2 rescued: a frame on the missed list that holds pixels after all."""
    f, m = filled.select(*FRAME).distinct().withColumn("_f", F.lit(True)), missed.select(*FRAME).distinct().withColumn("_m", F.lit(True))
    s = spine.join(f, FRAME, "left").join(m, FRAME, "left")
    return s.select(*FRAME, F.when(F.col("_f").isNull(), 0).when(F.col("_m"), 2).otherwise(1).alias("status"))


def roi_rect(px: DataFrame, r0: int, r1: int, c0: int, c1: int, fill: float = 0.0, height: int = 8, width: int = 8) -> DataFrame:
    """Intensity outside the clamped half-open box becomes fill; a degenerate box changes nothing."""
    a, b, c, d = max(0, r0), min(height, r1), max(0, c0), min(width, c1)
    if a >= b or c >= d:
        return px
    inside = (F.col("row_") >= a) & (F.col("row_") < b) & (F.col("col_") >= c) & (F.col("col_") < d)
    return px.withColumn("intensity", F.when(inside, F.col("intensity")).otherwise(F.lit(fill)))


def roi_ellipse(px: DataFrame, cy: float, cx: float, ry: float, rx: float) -> DataFrame:
    inside = ((F.col("col_") - cx) / rx) ** 2 + ((F.col("row_") - cy) / ry) ** 2 <= 1
    return px.withColumn("intensity", F.when(inside, F.col("intensity")).otherwise(0.0))


def roi_polygon(px: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Even-odd rule over the (row, col) corners, which are parameters and so literals of the plan."""
    crossings: Column = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, corners[1:] + corners[:1]):
        if y1 == y2:
            continue
        spans = (F.col("row_") >= min(y1, y2)) & (F.col("row_") < max(y1, y2))
        crossings = crossings + F.when(spans & (F.col("col_") < F.lit(x1) + (F.col("row_") - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return px.withColumn("intensity", F.when(crossings % 2 == 1, F.col("intensity")).otherwise(0.0))
