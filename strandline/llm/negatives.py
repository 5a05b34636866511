"""Hard-negative mining: a spanning tree over anchors bounds scores, and only candidates that a bound lets into a window are scored again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.primitives import value_bucket
from strandline.functions.staging import staged

#: Positives looked for: one more than are used, as an anchor finds itself among the rows of its label.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between LOW and HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
TREE = "aid long, pos int, parent int, edge double"
FOUND = "aid long, score long, rid long, vec_id long"


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vectors with label (label+1)%labels where vec_id is divisible by every."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.cast("long").alias("label"), "embedding")


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    values = table.column("v").combine_chunks()
    return (values.flatten() if table.num_rows else pa.array([], pa.int32())).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with rows: in doubles where no sum can pass 2^53, else in 64-bit integers."""
    if len(c) and float(np.abs(a).sum()) * float(np.abs(c).max(initial=0)) < 2.0**53:
        return (c @ a).astype(np.int64)
    return (c.astype(np.int64) * a.astype(np.int64)).sum(axis=1)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree grown from row 0; parent is a place in order (-1 for the first), edge the distance to it."""
    n = len(x)
    squares = (x * x).sum(axis=1)
    near, link, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    order, at, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    place = np.zeros(n, np.int64)
    now = 0
    for k in range(n):
        order[k], place[now], left[now] = now, k, False
        if k:
            at[k], edge[k] = place[link[now]], np.sqrt(((x[now] - x[link[now]]) ** 2).sum())
        d = squares + squares[now] - 2 * (x @ x[now])
        closer = left & (d < near)
        near[closer], link[closer] = d[closer], now
        if k + 1 < n:
            now = int(np.where(left, near, np.inf).argmin())
    return order, at, edge


def _grow(group: pa.Table) -> pa.Table:
    order, parent, edge = spanning_tree(_matrix(group, group.column("dims")[0].as_py()))
    return pa.table({"aid": group.column("aid").take(pa.array(order)).combine_chunks(), "pos": pa.array(np.arange(len(order)), pa.int32()), "parent": pa.array(parent, pa.int32()), "edge": edge})


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, -inf where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _bounded(anchors: pa.Table, candidates: pa.Table, dims: int, choose) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every anchor (by row): the candidates that choose(anchor row, low, high) lets through, with their exact scores.

    Anchors come in tree order. Of each, low and high bound every candidate's score: exact for the first anchor, else the
    parent's bounds less and plus edge x norm. Those that are chosen are scored and become exact, also for the children.
    """
    x, c = _matrix(anchors, dims), _matrix(candidates, dims)
    norms = np.sqrt((c * c).sum(axis=1)) * (1 + 1e-12)
    parent, edge = anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy()
    waiting = np.bincount(parent[parent >= 0], minlength=len(x))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = {}
    for k in range(len(x)):
        if parent[k] < 0:
            exact = _scores(x[k], c).astype(np.float64)
            low, high = exact, exact
        else:
            p = int(parent[k])
            reach = np.floor(edge[k] * norms * (1 + 1e-12)) + 1
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        rows = np.flatnonzero(choose(k, low, high))
        scores = _scores(x[k], c[rows])
        if parent[k] >= 0 and waiting[k]:
            low, high = low.copy(), high.copy()
            low[rows] = high[rows] = scores
        if waiting[k]:
            bounds[k] = low, high
        out[k] = rows, scores
    return out


def _result(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: np.concatenate([p[j] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for j, n in enumerate(names)})


def _ids(candidates: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = candidates.column("vec_id").combine_chunks()
    return candidates.column("rid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)


def _positives(most: int):
    def run(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        parts = []
        if anchors.num_rows and candidates.num_rows:
            anchors = anchors.sort_by("pos")
            (rid, vec, null), aid = _ids(candidates), anchors.column("aid").to_numpy()
            found = _bounded(anchors, candidates, anchors.column("dims")[0].as_py(), lambda k, low, high: high >= _kth(low, most))
            for k, (rows, scores) in found.items():
                best = np.lexsort((rid[rows], vec[rows], null[rows], -scores))[:most]
                parts.append((np.full(len(best), aid[k]), scores[best], rid[rows[best]]))
        return _result(parts, ("aid", "score", "rid"))
    return run


def _in_window(score: np.ndarray, positive: int) -> np.ndarray:
    return (100 * score >= LOW * positive) & (100 * score <= HIGH * positive)


def _negatives(most: int):
    def run(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        parts = []
        if anchors.num_rows and candidates.num_rows:
            anchors = anchors.sort_by("pos")
            (rid, vec, null), aid, own = _ids(candidates), anchors.column("aid").to_numpy(), anchors.column("label").to_numpy()
            label = candidates.column("label").to_numpy()
            positives = [sorted(set(p)) for p in anchors.column("positives").to_pylist()]

            def choose(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                """Candidates of other labels that may be among the best of a window, by what is sure to lie in it."""
                chosen, other = np.zeros(len(label), bool), label != own[k]
                for p in positives[k]:
                    bottom, top = LOW * p / 100 - 1e-6 * abs(p), HIGH * p / 100 + 1e-6 * abs(p)
                    sure = other & _in_window(low, p) & _in_window(high, p)
                    chosen |= other & (high >= max(bottom, _kth(low[sure], most))) & (low <= top)
                return chosen

            for k, (rows, scores) in _bounded(anchors, candidates, anchors.column("dims")[0].as_py(), choose).items():
                for p in positives[k]:
                    fits = np.flatnonzero(_in_window(scores, p))
                    at = rows[fits]
                    best = np.lexsort((rid[at], vec[at], null[at], -scores[fits]))[:most]
                    parts.append((np.full(len(best), aid[k]), np.full(len(best), p), scores[fits[best]], rid[at[best]]))
        return _result(parts, ("aid", "positive_score", "score", "rid"))
    return run


def _first(rows: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first rows of a key, with their place; each task keeps its own first ones before the shuffle."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, group_rows: int = 512, chunk_values: int = 1 << 19,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that anchor marks and each of its
    first rows of the same label, the first rows of other labels whose score lies in the positive's window.

    Components become floor(256 x), a row's score is the inner product with the anchor's, higher ones come first, ties by smaller id (null
    ids last). Equal anchors are one. They are cut into groups of about group_rows (of one label for positives, of all for
    negatives), neighbours on a random line together, and each group gets a minimum spanning tree. Candidates are cut by hash into chunks of chunk_values components;
    each pair of group and chunk is a task that walks the tree: the parent's score plus and minus edge length times the candidate's
    norm bounds the child's, and only candidates whose bounds reach the first rows (positives) or a window (negatives) are scored. Tasks
    leave their first rows, which are merged. Of equal vectors of a label, only the first ones by id can count and go on.

    Rows with null labels or vectors, empty vectors and vectors with null or non-finite components take no part; vectors of
    other lengths don't meet. Components beyond 2^26 count as 2^26. Repeated rows and other rows of an
    equal id are other rows. An anchor without positives, or without rows in a window, gives none; so does an empty table.
    Other columns are ignored.
    """
    v = F.col(vector_col)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(1 << 26)
    whole = F.transform(v, lambda x: F.least(F.lit(most), F.greatest(F.lit(-most), F.floor(x.cast("double") * SCALE).cast("double"))).cast("int"))
    rows = vectors.where(F.coalesce(F.col(label_col).isNotNull() & v.isNotNull() & fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.size(v).alias("dims"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    by_id = [F.asc_nulls_last("vec_id"), F.asc("rid")]

    classes = rows.where("is_anchor").groupBy("label", "dims", "v").agg(F.count("*").alias("copies"))
    line = F.aggregate(F.transform("v", lambda x, i: x * F.sin((i + 1) * F.lit(12.9898)) ), F.lit(0.0), lambda s, x: s + x)
    classes = classes.select("label", "dims", "v", F.monotonically_increasing_id().alias("aid"), line.alias("line"))
    classes = staged(classes, "anchors")

    def grown(keys: list[str]) -> DataFrame:
        """The anchors in groups of a key, each group with its tree. Up to 64 groups a key are cut at quantiles of the line; beyond, each of these is split by hash."""
        cuts = classes.groupBy(*keys).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("n"), F.percentile_approx("line", [k / 64 for k in range(1, 64)], 2000).alias("q"))
        chosen = F.expr("CASE WHEN n > 1 THEN transform(sequence(1, least(n, 64) - 1), k -> get(q, cast(k * 64 / least(n, 64) AS int) - 1)) ELSE slice(q, 1, 0) END")
        split = F.pmod(F.xxhash64("aid"), F.greatest(F.lit(1), F.ceil(F.col("n") / 64)))
        cut = classes.join(cuts.withColumn("q", chosen), keys).withColumn("g", value_bucket(F.col("line"), F.col("q"), 64) + 64 * split).drop("n", "q", "line")
        return staged(cut.join(cut.groupBy(*keys, "g").applyInArrow(_grow, TREE), "aid"), "trees")

    chunk = F.greatest(F.lit(16), F.floor(F.lit(chunk_values) / F.col("dims")))
    part = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")

    def pairs(candidates: DataFrame, keys: list[str], asked: DataFrame, run, schema: str) -> DataFrame:
        """run over every group of anchors and chunk of candidates that agree in keys."""
        parts = candidates.groupBy(*keys).agg(F.ceil(F.count("*") / F.first(chunk)).cast("int").alias("parts"))
        dealt = candidates.join(parts, keys).withColumn("part", part(F.col("parts"))).drop("parts").join(asked.select(*keys, F.col("g").alias("group")).distinct(), keys)
        sent = asked.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return sent.groupBy(*keys, "g", "part").cogroup(dealt.groupBy(*keys, "group", "part")).applyInArrow(run, schema)

    firsts = staged(_first(rows.drop("is_anchor"), ["label", "dims", "v"], max(positives + 1, negatives), by_id).drop("place"), "candidates")
    named = firsts.select("rid", "vec_id")
    met = pairs(firsts, ["label", "dims"], grown(["label", "dims"]), _positives(positives + 1), "aid long, score long, rid long").join(named, "rid")
    best = staged(_first(met, ["aid"], positives + 1, [F.desc("score"), *by_id]), "positives")

    asked = grown(["dims"]).join(best.groupBy("aid").agg(F.collect_set("score").alias("positives")), "aid")
    near = pairs(firsts, ["dims"], asked, _negatives(negatives), "aid long, positive_score long, score long, rid long").join(named, "rid")
    near = _first(near, ["aid", "positive_score"], negatives, [F.desc("score"), *by_id]).select("aid", "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    own = rows.where("is_anchor").join(classes.select("aid", "label", "dims", "v"), ["label", "dims", "v"]).select("aid", F.col("rid").alias("own"), F.col("vec_id").alias("anchor_id"))
    met = own.join(best, "aid").where("rid <> own").withColumn("n", F.row_number().over(W.partitionBy("own").orderBy("place"))).where(F.col("n") <= positives)
    met = met.select("aid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return met.join(near, ["aid", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
