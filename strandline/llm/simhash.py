"""SimHash near-duplicates: one-wildcard segment signatures, an equality join and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandline.functions.graph import connected_components
from strandline.functions.staging import staged
from strandline.llm.blocks import spanning_edges

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def words_digest(words: list[bytes]) -> int:
    """Digest of the words in their order: texts of equal words have equal shingles of every size."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the shingles of `size` words in their order, with repeats; fewer words make one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    stop = (start + length)[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop)), np.uint64, len(stop))


def majority(hashes: np.ndarray, draw: int = 0) -> int:
    """64-bit SimHash of 64-bit hashes: a bit is set when over half of them set it; none gives 0.

    draw > 0 mixes the hashes first (Fixed values: the multipliers of splitmix64), which gives fingerprints independent of each other.
    """
    if draw:
        hashes = hashes + np.uint64(0x9E3779B97F4A7C15 * draw & 0xFFFFFFFFFFFFFFFF)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes = hashes ^ (hashes >> np.uint64(31))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 4, distinct: bool = False, draw: int = 0) -> int:
    """64-bit SimHash of the shingles of `size` words, repeats counted unless distinct.

    Words are runs of anything but space and \\t to \\r, A-Z lower-cased. Fewer words make one shingle; none gives 0.
    """
    hashes = shingle_hashes(_words(text), size)
    return majority(np.unique(hashes) if distinct else hashes, draw)


#: Columns of with_simhash: (name, words of a shingle or 0 for the digest of the words, whether repeats are left out, draw).
Kinds = tuple[tuple[str, int, bool, int], ...]


def with_simhash(docs: DataFrame, text_col: str = "text", kinds: Kinds = (("fp", 4, False, 0),)) -> DataFrame:
    """docs without text_col plus one signed long per kind. No shuffle.

    Null and wordless texts have 0; long texts count whole; repeated rows stay; an empty table gives none; columns named as a kind are replaced.
    """
    rows = docs.drop(*[k[0] for k in kinds])
    rows = rows.select(*[c for c in rows.columns if c != text_col], F.col(text_col).alias("_text"))
    out = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"{k[0]} long" for k in kinds])
    schema = to_arrow_schema(_parse_datatype_string(out))

    def prints_of(text: str | None) -> list[int]:
        words, made, hashes = _words(text), [], {}
        for _, size, distinct, draw in kinds:
            if not size:
                made.append(words_digest(words))
                continue
            if (size, distinct) not in hashes:
                found = shingle_hashes(list(dict.fromkeys(words)) if distinct and size == 1 else words, size)
                hashes[size, distinct] = np.unique(found) if distinct else found
            made.append(majority(hashes[size, distinct], draw))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([prints_of(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.uint64).reshape(-1, len(kinds)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(prints[:, k]) for k in range(len(kinds)))], schema=schema)

    return rows.mapInArrow(run, out)


def variants(fp: Column, bits: int) -> Column:
    """Index keys of a fingerprint: the 64 bits are cut into the fewest segments of which one has at most one of `bits`
    differing bits; for every bit of a segment, the segment with that bit blanked, tagged with the bit."""
    parts = bits // 2 + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    keys = []
    for lo, hi in zip(edges, edges[1:]):
        value = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        keys += [value.bitwiseAND(F.lit(~(1 << j)).cast("long")).bitwiseOR(F.lit((lo + j) << (hi - lo)).cast("long")).bitwiseOR(F.lit(lo << 56).cast("long")) for j in range(hi - lo)]
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Whether every column of two (..., columns) arrays of fingerprints differs in at most its limit of bits."""
    return np.logical_and.reduce([np.bitwise_count((a[..., k] ^ b[..., k]).view(np.uint64)) <= limit for k, limit in enumerate(limits)])


def _link_runs(limits: tuple[int, ...], hot: int, names: list[str]):
    """Over rows (key, node, fingerprints) sorted by key: star edges (node, root, false, zeros) of the links among equal keys; the
    rows of a run longer than hot are passed on as (key, node, true, fingerprints)."""

    def out(nodes: np.ndarray, roots: np.ndarray, passed: np.ndarray) -> pa.RecordBatch:
        n, prints = len(nodes), passed[:, 2:]
        columns = [np.concatenate([nodes, passed[:, 0]]), np.concatenate([roots, passed[:, 1]]), np.arange(n + len(passed)) >= n]
        columns += [np.concatenate([np.zeros(n, np.int64), prints[:, k]]) for k in range(prints.shape[1])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "hot", *names])

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        key = rows[:, 0]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        big = np.repeat(size > hot, size)
        passed, rows = rows[big], rows[~big]
        key, node, prints = rows[:, 0], rows[:, 1], rows[:, 2:]
        at, u, v = np.arange(len(key)), [node[:0]], [node[:0]]
        for d in range(1, hot + 1):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[_near(prints[at], prints[at + d], limits)]
            u.append(node[near])
            v.append(node[near + d])
        return out(*spanning_edges(np.concatenate(u), np.concatenate(v)), passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        passing: int | None = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if passing is not None and len(rows):
                more = rows[:, 0] == passing
                if more.any():
                    yield out(rows[:0, 0], rows[:0, 0], rows[more])
                rows = rows[~more]
            if not len(rows):
                continue
            passing = None
            rows = rows if held is None else np.concatenate([held, rows])
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield settle(rows[:last])
            held = rows[last:]
            if len(held) > hot:
                passing = int(held[0, 0])
                yield out(held[:0, 0], held[:0, 0], held)
                held = None
        if held is not None:
            yield settle(held)

    return run


def _block_links(limits: tuple[int, ...], names: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["chunk", "node"])
        x, y = (group.loc[group["chunk"] == c, ["node", *names]].to_numpy(np.int64) for c in (group["i"].iat[0], group["j"].iat[0]))
        u, v = [x[:0, 0]], [x[:0, 0]]
        for lo in range(0, len(x), 512):
            a, b = np.nonzero(_near(x[lo:lo + 512, None, 1:], y[None, :, 1:], limits))
            n, r = spanning_edges(x[lo + a, 0], y[b, 0])
            u.append(n)
            v.append(r)
        nodes, roots = spanning_edges(np.concatenate(u), np.concatenate(v))
        return pd.DataFrame({"a": nodes, "b": roots})
    return run


def link_fingerprints(prints: DataFrame, limits: dict[str, int], hot: int = 2048, chunk: int = 2048) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly those reachable by links.

    prints(node, fingerprints): limits gives each fingerprint column the bits two linked nodes may differ in; the first
    column is the indexed one, others verify. Every distinct node is indexed under its one-wildcard variants; rows are
    dealt and sorted by key, and rows of equal keys are compared. A linked set leaves one edge per node, not its pairs.
    The rows of a key with more than `hot` nodes are passed on; they are cut by hash into chunks, every pair of chunks is a
    task of its own, and again each leaves only spanning edges: no link is lost and no task holds more than two chunks.
    Repeated rows count once, nodes and fingerprints are not null, and an empty table gives no edges.
    """
    names, most = list(limits), tuple(limits.values())
    keyed = prints.select("node", *names).distinct().withColumn("key", F.explode(variants(F.col(names[0]), most[0]))).select("key", "node", *names)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "a long, b long, hot boolean, " + ", ".join(f"{c} long" for c in names)
    found = staged(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link_runs(most, hot, names), fields), "links")
    edges = found.where("not hot and a <> b").select("a", "b")
    rows = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("node"), *names)
    if rows.isEmpty():
        return edges
    sizes = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = rows.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", "node", *names, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return edges.unionByName(rows.groupBy("key", "i", "j").applyInPandas(_block_links(most, names), "a long, b long").where("a <> b"))


def _like(x: np.ndarray, y: np.ndarray, likeness: float) -> bool:
    """Whether two sets, as arrays without repeats, have a Jaccard likeness of at least likeness; empty ones are equal."""
    low, high = sorted((len(x), len(y)))
    if low < likeness * high - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= likeness * (low + high - both) - 1e-9


def _like_links(limits: tuple[int, ...], names: list[str], likeness: float):
    """Spanning edges of the pairs between two chunks that are near by fingerprints and alike by sets; pairs that others already connect are not compared."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["chunk", "node"])
        i, j = group["i"].iat[0], group["j"].iat[0]
        x, y = (np.flatnonzero(group["chunk"] == c) for c in (i, j))
        node, prints, sets = group["node"].to_numpy(np.int64), group[names].to_numpy(np.int64), group["shingles"].tolist()
        root = list(range(len(node)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for lo in range(0, len(x), 512):
            a, b = np.nonzero(_near(prints[x[lo:lo + 512], None], prints[None, y], limits))
            for p, q in zip(x[lo + a].tolist(), y[b].tolist()):
                if (p < q or i != j) and (r := find(p)) != (s := find(q)) and _like(sets[p], sets[q], likeness):
                    root[max(r, s)] = min(r, s)
        return pd.DataFrame({"a": node, "b": node[[find(k) for k in range(len(node))]]})
    return run


def verified_links(docs: DataFrame, nodes: DataFrame, limits: dict[str, int], shingle: int, likeness: float, id_col: str, text_col: str, chunk: int = 1024, most: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes reachable by links whose sets of shingles have that exact Jaccard likeness.

    nodes(node, words, fingerprints, root, rep) names the candidates (equal root), and for each node a row of docs by id
    and digest of its words. Sets are made of nodes that have another candidate only. Candidates are cut by hash into chunks
    of about `chunk` nodes and `most` hashes, and every pair of chunks is a task of its own, which leaves spanning edges.
    """
    names = list(limits)
    crowds = nodes.groupBy("root").count().where("count > 1").select("root")
    wanted = nodes.join(crowds, "root", "left_semi").select("node", F.col("words").alias("_said"), *names, "root", F.col("rep").alias("_rep"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, F.col("_id").eqNullSafe(F.col("_rep"))).select("node", "_said", *names, "root", "_text")
    fields = "node long, " + ", ".join(f"{c} long" for c in names) + ", root long, shingles array<long>"
    schema = to_arrow_schema(_parse_datatype_string(fields))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*held), schema)], schema=schema)

        held, size = [], 0
        for batch in batches:
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                row = [c[k].as_py() for c in batch.columns[:-1]]
                words = _words(text.as_py())
                if np.uint64(words_digest(words)).astype(np.int64) == row[1]:
                    held.append((row[0], *row[2:], np.unique(shingle_hashes(words, shingle)).view(np.int64)))
                    size += len(held[-1][-1])
                if size > most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    sets = staged(rows.mapInArrow(made, fields), "shingles").dropDuplicates(["node"])
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.size("shingles")) / most), F.lit(1)).cast("int").alias("chunks"))
    rows = sets.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("root", "node", *names, "shingles", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return rows.groupBy("root", "i", "j").applyInPandas(_like_links(tuple(limits.values()), names, likeness), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4, confirm: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", likeness: float | None = None, draws: int = 1) -> DataFrame:
    """(id, fp, component_id) for every row of docs; component_id is the smallest id reachable over links.

    Without confirm, fingerprints of shingles of `size` words, repeats counted, link at `bits` or fewer differing bits. With
    confirm = (shingle, limit), the indexed fingerprints are `draws` independent ones of the distinct shingles of `size` words,
    of which one must be that close, and a link must also differ in at most `limit` bits of a last fingerprint, of shingles of
    `shingle` words: near copies with scattered edits stay close in their words but not in long shingles, so the first ones find
    them and the last verifies. Several draws find more of them than one with a wider limit, and their keys stay longer. With
    likeness too, that only makes candidates: a link is two candidates of one component within `limit` bits that have that
    exact Jaccard likeness of the sets of shingles of `shingle` words, and texts of equal words, not of equal
    fingerprints, are one node.

    Equal fingerprints are one node of the link graph, so copies cost nothing. Null and wordless texts have
    fingerprint 0 and link like any other; rows with equal ids keep their own rows; null ids are never the smallest id
    unless all of a component are null; empty tables give no rows; other columns are ignored.
    """
    if (likeness is not None or draws > 1) and not confirm:
        raise ValueError("likeness and draws need confirm")
    indexed = ["fp"] + [f"fp_{k}" for k in range(1, draws)]
    kinds = [(name, size, confirm is not None, k) for k, name in enumerate(indexed)]
    second = {"fp2": confirm[1]} if confirm else {}
    kinds += [("fp2", confirm[0], False, 0)] if confirm else []
    kinds += [("words", 0, False, 0)] if likeness is not None else []
    told = [k[0] for k in kinds]
    node = F.xxhash64(*told) if confirm else F.col("fp")
    prints = staged(with_simhash(docs.select(id_col, text_col), text_col, tuple(kinds)).withColumn("node", node), "simhash")
    nodes = prints.groupBy("node", *(["fp2", "words"] if likeness is not None else [])).agg(F.min(id_col).alias("rep"))
    edges = link_fingerprints(prints, {"fp": bits} | second)
    for name in indexed[1:]:
        edges = edges.unionByName(link_fingerprints(prints, {name: bits} | second))
    parts = connected_components(edges)
    nodes = nodes.join(parts, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    nodes = staged(nodes, "nodes")
    if likeness is not None:
        parts = connected_components(verified_links(docs, nodes, second, confirm[0], likeness, id_col, text_col))
        nodes = staged(nodes.select("node", "rep").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "rep"), "nodes")
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = staged(nodes.join(least, "root").select("node", "component_id"), "groups")
    return prints.join(groups, "node").select(id_col, "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
