"""Per-object user functions over cropped masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.masks import OBJECT, convex_areas


def per_object_apply(px: DataFrame, fn: Callable[[np.ndarray], np.ndarray], pad: int = 5) -> DataFrame:
    """fn(boolean crop) -> boolean crop of every object in its box padded by pad; an exception keeps the object as it is.

    An object's pixels are one array, and an Arrow batch holds many objects: fn is called once for each, without a group of its own.
    """
    def crop_of(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r0, c0 = row.min() - pad, col.min() - pad
        crop = np.zeros((row.max() + pad + 1 - r0, col.max() + pad + 1 - c0), bool)
        crop[row - r0, col - c0] = True
        try:
            out = np.asarray(fn(crop.copy()), bool)
            if out.shape != crop.shape:
                raise ValueError("shape changed")
        except Exception:  # the user's function may fail on one object only
            out = crop
        r, c = np.nonzero(out)
        return r + r0, c + c0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pixels")
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            row, col = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("row_", "col_"))
            found = [crop_of(r, c) for r, c in zip(np.split(row, ends[:-1]), np.split(col, ends[:-1]))] if len(lists) else []
            owner = pa.array(np.repeat(np.arange(len(found)), [len(r) for r, _ in found]))
            at = [pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype("int32")) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in OBJECT), *at], [*OBJECT, "row_", "col_"])

    kinds = dict(px.dtypes)
    each = px.groupBy(*OBJECT).agg(F.collect_list(F.struct(F.col("row_").cast("int").alias("row_"), F.col("col_").cast("int").alias("col_"))).alias("pixels"))
    return each.mapInArrow(run, f"recording_id {kinds['recording_id']}, frame {kinds['frame']}, label {kinds['label']}, row_ int, col_ int")


def solidity(px: DataFrame) -> DataFrame:
    """Area over convex-hull area of every object (masks.convex_areas)."""
    return px.groupBy(*OBJECT).count().join(convex_areas(px), OBJECT).selectExpr(*OBJECT, "count / convex as solidity")
