"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.staging import staged

KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and \\t to \\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(id_col: str, size: Column, seed: str) -> Column:
    """A key uniform in [0, 2^60) that depends on the seed, the id and the size alone: rows that share an id (or null) spread by their sizes."""
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("-"), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source.

    Sources in code-point order, null last, have the weights in turn, repeating, and share `share` times all sizes by
    weight; a target stops at `most` times its source's size and the excess goes to the others by weight. The fixed
    point is target = min(cap, level * weight): in the order of cap / weight the full sources form a prefix, and the
    level follows from running sums over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    named = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    sums = (
        named.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
    )
    level = F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(whole)
    target = F.when(F.col("cap") > level * F.col("w"), level * F.col("w")).otherwise(F.col("cap"))
    return sums.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", rows_per_bucket: int = 2_000, spans: int = 1_000,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of docs with size, source_size, target, taken (words) and copies (whole repeats, the cut one counted).

    A source's documents are laid out in the order of hash-random keys. Key ranges (buckets) of about rows_per_bucket
    rows of the largest source are summed first, and prefix sums over the totals of runs of `spans` buckets, then over the buckets
    of a run, give every bucket its start; a window within (source, bucket) gives each document's start. So a source with a third of all rows is spread over as
    many tasks as it has buckets. Full epochs repeat every document; the rest of the budget is cut at its exact word
    inside the document where it ends. Only narrow columns are staged and shuffled; the texts stay with
    the rows that the caller joins by id, and are read once.

    Null texts have size 0 and take 0 words; null sources are a source of their own, last; rows with equal id and size
    are interchangeable and each has its own place; empty tables give no rows; further columns of docs are ignored.
    """
    rows = docs.select(id_col, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("_key", random_key(id_col, F.col("size"), seed))
    largest = docs.groupBy(source_col).count().agg(F.max("count")).first()[0] or 1
    width = -(-(1 << KEY_BITS) // max(1, -(-largest // rows_per_bucket)))
    rows = staged(rows.withColumn("_bucket", F.expr(f"_key div {width}")), "sizes")
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    totals = totals.withColumn("_span", F.expr(f"_bucket div {spans}"))
    earlier = W.partitionBy("source").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("source", "_span").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    spanned = totals.groupBy("source", "_span").agg(F.sum("_sum").alias("_sum")).select(F.col("source").alias("_s"), F.col("_span").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(within), F.lit(0))).join(spanned, F.expr("source <=> _s and _span = _at"))
    starts = starts.select("source", "_bucket", (F.col("_base") + F.col("_start")).alias("_start"))
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select(F.col("s.source").alias("b_source"), F.col("_bucket").alias("b_bucket"), "_start", "source_size", "target")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.expr("source <=> b_source and _bucket = b_bucket"))
    words = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("_full") * F.col("source_size") - F.col("_start") - F.col("_in")))
    return (
        placed.withColumn("_full", full.cast("long")).withColumn("_part", part.cast("long"))
        .select(id_col, "source", "size", "source_size", "target", (F.col("_full") * F.col("size") + F.col("_part")).alias("taken"),
                (F.col("_full") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("int").alias("copies"))
    )
