"""Dealing rows to ranges of an ordered id, with hot ids split by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _below(value: Column, bounds: list[int], equal: bool) -> Column:
    """How many of the sorted bounds are below the value (or equal to it too), by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << j for j in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # one literal, folded once: a hundred thousand bounds are planned in a moment
    passed = (lambda x: x <= value) if equal else (lambda x: x < value)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & passed(F.get(table, at + s - 1)), at + s).otherwise(at))


def id_ranges(docs: DataFrame, id_col: str, rows_per_range: int = 50_000, ranges: int | None = None) -> tuple[list[int], int]:
    """(bounds, ranges of null ids) of a long id: bounds at quantiles, where an id that many rows share is repeated.

    There are four ranges for each shuffle partition or one for every rows_per_range rows, whichever is more, so ranges grow in
    number and not in size; null ids get as many of their own as their share of the rows asks for.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("i")).agg(F.count("*").alias("n"), F.count("i").alias("known")).first()
    count = ranges or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // rows_per_range))
    cuts = [j / count for j in range(1, count)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, max(10_000, 20 * count)).alias("b")).first()["b"] if cuts and seen["known"] else None
    return sorted(found or []), max(1, -(-count * (seen["n"] - seen["known"]) // max(1, seen["n"])))


def range_of(id_col: Column, hash_col: Column, bounds: list[int], nulls: int) -> Column:
    """The range of a row; ranges follow the order (id with null last, hash).

    An id that lies on several bounds has the ranges between them: its rows are dealt by the order of a uniform 64-bit hash.
    """
    value = id_col.cast("long")
    share = hash_col / F.lit(2.0**64) + 0.5
    low, high = _below(value, bounds, False), _below(value, bounds, True)
    width = F.when(id_col.isNull(), F.lit(nulls)).otherwise(high - low + 1)
    start = F.when(id_col.isNull(), F.lit(len(bounds) + 1)).otherwise(low)
    return (start + F.least(width - 1, F.floor(share * width))).cast("int")
