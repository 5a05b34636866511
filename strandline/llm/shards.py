"""Training-order materialisation: fixed-length token records at keyed-permutation slots, in fixed-stride shards."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandline.functions.staging import shuffle_files_dropped, staged
from strandline.llm.pieces import PieceCoder, slices
from strandline.llm.ranges import id_ranges, range_of


class Permutation:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked until it lands below n."""

    def __init__(self, n: int, key: str, rounds: int = 6):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        digest = b"".join(hashlib.sha256(f"{key}:{r}".encode()).digest()[:16] for r in range(rounds))
        self.keys = np.frombuffer(digest, np.uint64).reshape(rounds, 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, key: np.ndarray) -> np.ndarray:
        x = (x + key[0]) * (key[1] | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._mix(left, key), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while (far := out >= self.n).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._once)

    def index(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._back)


def _encode(model: str, length: int, schema: pa.Schema):
    """(range, id, hash, text) to (range, id, hash, n_ids, n_seqs, ids): ids of the whole text, 16-bit and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model)
        for batch in batches:
            for part in slices(batch, 3):
                flat, bounds = coder.encode_flat(part.column(3))
                flat, n = flat.astype("<u2"), np.diff(bounds)
                packed = [pa.compress(flat[a:b].tobytes(), "zstd", asbytes=True) for a, b in itertools.pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), pa.array(-(-n // length)), pa.array(packed, pa.binary())], schema=schema)
    return run


def _cut(order: Permutation, length: int, schema: pa.Schema, low: int, high: int, most: int = 16_384):
    """(id, place, n_ids, ids) to one row per sequence whose slot is in [low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            seqs = -(-n // length)
            part = (np.cumsum(seqs) - seqs) // most
            for a, b in itertools.pairwise(np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(n)]):
                first = np.cumsum(seqs[a:b]) - seqs[a:b]
                rows = np.repeat(np.arange(a, b), seqs[a:b])
                seq = np.arange(len(rows)) - np.repeat(first, seqs[a:b])
                slots = order.slots(place[rows] + seq)
                kept = np.flatnonzero((slots >= low) & (slots < high))
                padded = np.zeros((len(rows), length), "<u2")
                flat = padded.reshape(-1)
                for k in np.unique(rows[kept]).tolist():
                    at = int(first[k - a]) * length
                    flat[at:at + n[k]] = np.frombuffer(pa.decompress(batch.column(3)[k].as_py(), int(2 * n[k]), "zstd", asbytes=True), "<u2")
                rows, seq = rows[kept], seq[kept]
                records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(rows), [None, pa.py_buffer(padded[kept])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(slots[kept]), batch.column(0).take(pa.array(rows)), pa.array(seq.astype(np.int32)),
                    pa.array(np.minimum(length, n[rows] - seq * length).astype(np.int32)), records], schema=schema)
    return run


def _places(docs: DataFrame, model: str, length: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, place, n_ids, ids) of every text, staged once, and the number of sequences; place is that of its first sequence."""
    if PieceCoder(model).sp.get_piece_size() > 1 << 16:
        raise ValueError("16-bit records need a vocabulary of at most 65,536 pieces")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bounds, nulls = id_ranges(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    coded = f"range int, id {rows.dtypes[0][1]}, hash long, n_ids long, n_seqs long, ids binary"
    rows = rows.select(range_of(F.col("id"), F.col("hash"), bounds, nulls).alias("range"), "id", "hash", "text").mapInArrow(_encode(model, length, to_arrow_schema(_parse_datatype_string(coded))), coded)
    before = W.partitionBy("range").orderBy(F.col("id").asc_nulls_last(), "hash").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("n_seqs").over(before), F.lit(0)))
    placed = staged(placed.drop("hash"), "encoded", compression="zstd")
    sizes = placed.groupBy("range").agg(F.sum("n_seqs").alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return placed.join(F.broadcast(starts), "range").select("id", (F.col("start") + F.col("at")).alias("place"), "n_ids", "ids"), total


def _ordered(places: DataFrame, order: Permutation, first: int, shards: int, length: int, per_shard: int, shards_per_task: int, id_col: str) -> DataFrame:
    """The sequences of so many shards from the first on, dealt to tasks by ranges of slots and sorted."""
    fields = f"slot long, `{id_col}` {places.dtypes[0][1]}, seq int, n_tokens int, record binary"
    cut = _cut(order, length, to_arrow_schema(_parse_datatype_string(fields)), first * per_shard, (first + shards) * per_shard)
    tasks = min(shards, max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // shards_per_task)))
    shard = F.expr(f"slot div {per_shard}")
    ranges = places.mapInArrow(cut, fields).repartitionById(tasks, ((shard - first) * tasks / shards).cast("int")).sortWithinPartitions("slot")
    return ranges.select("slot", shard.cast("int").alias("shard"), ((F.col("slot") % per_shard) * (2 * length)).alias("offset"), id_col, "seq", "n_tokens", "record")


def training_order(docs: DataFrame, model: str, key: str = "order-1", length: int = 512, per_shard: int = 16_384, shards_per_task: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence in training order: slot, shard, offset, id, seq, n_tokens, record.

    Texts are encoded whole with begin and end ids and cut into sequences of `length` ids (unsigned 16-bit, little-endian;
    the last one of a text is filled with zeros, n_tokens says how many count). A sequence's place is its number in the
    order (id with null last, hash of the text, seq), so one table and key give one training order however the table is
    laid out; id is a whole number. Encoded texts are dealt to ranges of that order and staged once with their place in
    the range; prefix sums over one count per range (the broadcast table) make the places dense, and a keyed Feistel
    permutation with cycle-walking turns place into slot. Shard s holds slots [s * per_shard, (s + 1) * per_shard), in order,
    where slot lies at byte (slot - s * per_shard) * 2 * length. Slots are uniform over a known range, so ranges of slots
    need no sampling and are equal; a task has at most shards_per_task of them, or one for each shuffle partition.

    Null and empty texts are one sequence of the begin and end ids; long texts give as many sequences as they need;
    repeated rows have their own; empty tables give no rows; other columns are ignored.
    """
    places, total = _places(docs, model, length, id_col, text_col)
    return _ordered(places, Permutation(total, key), 0, max(1, -(-total // per_shard)), length, per_shard, shards_per_task, id_col)


def materialise(docs: DataFrame, model: str, folder: str, key: str = "order-1", length: int = 512, per_shard: int = 16_384, shards_per_task: int = 8, waves: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all shards of training_order into folder and return their index: slot, shard, offset, id, seq, n_tokens.

    The shards are written in so many waves, each a job over the staged encoded texts that shuffles the records of its own
    shards only. So the shuffled records of one wave lie on disk at a time, beside encoded texts and shards, and a run that
    breaks off has whole shards of the waves before. Records are in the shards, at their offset, and not in the index.

    Nulls, empty and long texts, repeated rows, empty tables (no rows, no shards) and other columns: as training_order.
    """
    places, total = _places(docs, model, length, id_col, text_col)
    order, shards = Permutation(total, key), max(1, -(-total // per_shard))
    per_wave, index = -(-shards // waves), []
    for first in range(0, shards, per_wave):
        rows = _ordered(places, order, first, min(per_wave, shards - first), length, per_shard, shards_per_task, id_col)
        with shuffle_files_dropped(docs.sparkSession):
            index.append(staged(write_shards(rows, folder, index=True), "index"))
    return functools.reduce(DataFrame.unionByName, index)


def qualified(spark: SparkSession, folder: str) -> str:
    """folder as a URI, resolved as Spark resolves paths: without a scheme it lies in the cluster's default file system and not on an executor's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def write_shards(ordered: DataFrame, folder: str, index: bool = False) -> DataFrame:
    """Write the rows of training_order as folder/shard-NNNNNNNN.bin and return (shard, first_slot, sequences, bytes, sha256), or the rows without their records as an index.

    folder is a path of Spark's, in a file system that pyarrow too reaches from every executor (file:, hdfs:, s3:). A shard is written under a
    temporary name and moved into place, so a task that runs twice leaves the same file. The result is lazy; shards are written
    when it is computed. Readers resume at a slot by seeking to its offset in its shard. Of the columns only shard, slot and
    record are read, whatever the ids (null ones too); slots are unique, as training_order makes them, and no rows leave no shard.
    """
    rest = [c for c in ordered.columns if c != "record"] if index else []
    folder = qualified(ordered.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, stream, temp, digest, first, count, size = None, None, "", None, 0, 0, 0

        def close() -> list[pa.RecordBatch]:
            stream.close()
            path = f"{root}/shard-{now:08d}.bin"
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)
            store.move(temp, path)
            line = (now, first, count, size, digest.hexdigest())
            return [] if index else [pa.RecordBatch.from_arrays([pa.array([v]) for v in line], schema=schema)]

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, slot = (batch.column(k).to_numpy() for k in (0, 1))
            records = batch.column(2)
            at = np.frombuffer(records.buffers()[1], np.int32)[records.offset:records.offset + len(records) + 1].tolist()
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]):
                if shard[a] != now:
                    if stream:
                        yield from close()
                    now, temp = int(shard[a]), f"{root}/.shard-{shard[a]:08d}-{TaskContext.get().taskAttemptId()}-{os.getpid()}"
                    stream, digest, first, count, size = store.open_output_stream(temp), hashlib.sha256(), int(slot[a]), 0, 0
                data = records.buffers()[2].slice(at[a], at[b] - at[a])
                stream.write(data)
                digest.update(data)
                count += b - a
                size += len(data)
            if index:
                yield pa.RecordBatch.from_arrays(batch.columns[3:], schema=schema)
        if stream:
            yield from close()

    types = dict(ordered.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in rest) if index else "shard long, first_slot long, sequences long, bytes long, sha256 string"
    schema = to_arrow_schema(_parse_datatype_string(fields))
    keys = [F.col("shard").cast("long").alias("_shard"), F.col("slot").alias("_slot"), F.col("record").alias("_record")]
    return ordered.select(*keys, *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, fields)
