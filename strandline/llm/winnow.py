"""Document fingerprints by winnowing, and their likeness to an edited text and to the next document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.ranges import id_ranges, range_of

GAP = r"[\x20\x09-\x0D]+"
EMPTY = "array<struct<hash:bigint,pos:int>>"


def _rotated(x: Column, n: int) -> Column:
    return x if not n else F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def with_fingerprint(rows: DataFrame, text_col: str, out: str, k: int = 5, window: int = 4) -> DataFrame:
    """rows with out: array<struct<hash, pos>>, the winnowed prints of the text in order of position.

    Words are lower-cased runs of anything but space and \\t to \\r. The hash of a k-gram of words is a cyclic
    polynomial: the words' XXH64 values, each rotated once more than the one after it, combined by exclusive or. In
    every window of `window` consecutive k-grams the smallest hash is a print, the rightmost one among equals. So two
    texts that share window + k - 1 consecutive words share a print, and no print rests on fewer than k words. A print is
    found without building windows: going left over hashes not below its own, and right over hashes above it, must span
    a window. A text of fewer than k words is one k-gram; of fewer k-grams than a window, one window; null
    or wordless texts have no print.
    """
    w, h, n = f"_{out}_w", f"_{out}_h", f"_{out}_n"
    rows = rows.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), lambda x: x != ""))
    rows = rows.withColumn(w, F.transform(w, lambda x: F.xxhash64(x))).withColumn(n, F.size(w))

    def gram(i: Column) -> Column:
        value = F.get(w, i + k - 1)
        for j in range(k - 1):
            value = value.bitwiseXOR(_rotated(F.get(w, i + j), k - 1 - j))
        return value

    short = F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: _rotated(acc, 1).bitwiseXOR(x))
    grams = F.when(F.col(n) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - k, F.lit(0))), gram)).when(F.col(n) > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(h, grams).drop(w, n)

    def run(x: Column, i: Column, step: int, holds) -> Column:
        """How many neighbours in a row, window - 1 at most, satisfy holds."""
        length = F.lit(window - 1)
        for j in range(window - 1, 0, -1):
            length = F.when(holds(F.get(h, i + step * j), x), length).otherwise(j - 1)
        return length

    def chosen(x: Column, i: Column) -> Column:
        span = run(x, i, -1, lambda y, x: y >= x) + run(x, i, 1, lambda y, x: y > x)
        return F.when(span >= F.least(F.lit(window), F.size(h)) - 1, F.struct(x.alias("hash"), i.alias("pos")))

    return rows.withColumn(out, F.array_compact(F.transform(h, chosen))).drop(h)


def likeness(a: str, b: str) -> Column:
    """Shared share of the two prints' distinct hashes; two texts without prints are alike."""
    x, y = F.array_distinct(F.col(a)["hash"]), F.array_distinct(F.col(b)["hash"])
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def digest(prints: str) -> Column:
    """SHA-256 of the prints, each as hash@position."""
    return F.sha2(F.array_join(F.transform(prints, lambda p: F.concat_ws("@", p["hash"].cast("string"), p["pos"].cast("string"))), ","), 256)


def compare_neighbours(docs: DataFrame, k: int = 5, window: int = 4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its prints, those of its edited text, and both likenesses.

    The edited text is the text whose last floor(n / 2) code points are replaced by as many (or all) first ones of the
    next document by ascending id; the first follows the last. Rows are dealt to ranges of (id, text hash) cut at quantiles of the id
    (ranges.id_ranges; buckets sets their number), so the texts are shuffled once, ranges grow in number with the input, and an
    id (or null) that many rows share is spread over several; the next document of a range's last row is the first of the next range,
    looked up in a table of one row a range, whose ids (bounded by the number of ranges) are broadcast. Columns: id,
    n_chars, edited_sha256, prints, edited_prints, near_edited, near_next.

    Null texts are empty. Rows with null ids come last; rows with equal ids are ordered by their text's hash. A single
    row follows itself. Empty tables give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bounds, nulls = id_ranges(docs, id_col, ranges=buckets)
    base = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("text"), F.xxhash64(text).alias("_h"), range_of(F.col(id_col), F.xxhash64(text), bounds, nulls).alias("_bucket"))

    order = W.partitionBy("_bucket").orderBy(F.col(id_col).asc_nulls_last(), "_h")
    rows = base.withColumn("next_text", F.lead("text").over(order))
    rows = with_fingerprint(rows, "text", "prints", k, window)
    rows = rows.withColumn("next_prints", F.lead("prints").over(order))

    firsts = base.groupBy("_bucket").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_h")).alias("_f"))
    around = W.orderBy("_bucket")
    after = F.coalesce(F.lead(F.struct("_bucket", "_f")).over(around), F.first(F.struct("_bucket", "_f")).over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    follows = firsts.select(F.col("_bucket").alias("_of"), after.alias("_n")).select("_of", F.col("_n._bucket").alias("_in"), F.col(f"_n._f.{id_col}").alias("_id"), F.col("_n._f._h").alias("_first"))
    heads = base.join(F.broadcast(follows), (F.col("_bucket") == F.col("_in")) & F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first")))
    heads = heads.groupBy("_of").agg(F.min(F.struct("_h", "text"))["text"].alias("head_text"))
    heads = with_fingerprint(heads, "head_text", "head_prints", k, window)

    rows = rows.join(heads.withColumnRenamed("_of", "_bucket"), "_bucket", "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("next_text", "head_text")
    rows = rows.select(
        id_col, n.cast("long").alias("n_chars"), "prints", F.coalesce("next_prints", "head_prints").alias("next_prints"),
        F.concat(F.left("text", n - half), F.left(following, half)).alias("edited"),
    )
    rows = with_fingerprint(rows, "edited", "edited_prints", k, window)
    return rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "prints", "edited_prints", likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"))
