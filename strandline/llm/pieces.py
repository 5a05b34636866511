"""SentencePiece encoding with byte offsets into the source text, and decoding.

Normalisation walks the text: at each place the longest prefix that the model's compiled character map knows is
replaced, and every byte of the normalised text remembers where its source bytes begin and end. Pieces are laid on the
normalised text and projected to byte spans of the source. Models without a character map (the identity rule) only
turn spaces into the space mark and may add one in front, so spans follow from running sums of piece lengths.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from sentencepiece import sentencepiece_model_pb2 as model_pb2

MARK = "▁"
MARK_BYTES = MARK.encode()


class CharMap:
    """The compiled character map: a double-array trie from source byte strings to offsets of their replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        unit, node, best = self.units[0], 0, None
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if (unit & 0x800000FF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.texts[best[1]:self.texts.index(b"\0", best[1])]


class PieceCoder:
    """A SentencePiece model with offsets. Not picklable; make one per task from the model's file."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        self.charmap = CharMap(self.spec.precompiled_charsmap)
        pieces = [p.piece for p in proto.pieces]
        self.plain = not self.charmap.units and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces and self.spec.add_dummy_prefix
        self.by_word = self.plain and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and 4 not in kinds and not any(MARK in p.lstrip(MARK) for p in pieces)
        byte = np.array([k == 6 for k in kinds])
        self.length = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, byte)], np.int64)
        self.source = np.array([1 if b else len(p.encode()) - 2 * p.count(MARK) for p, b in zip(pieces, byte)], np.int64)
        self.control = np.array([k in (2, 3) for k in kinds])
        self.mark_id = self.sp.piece_to_id(MARK)

    def _parts(self, text: str) -> list[str]:
        """Space-free stretches, each with the spaces before it but one (which the space mark in front stands for)."""
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        parts, held = [], 0
        for word in text.split(" "):
            if word:
                parts.append(" " * held + word)
                held = 0
            else:
                held += 1
        return parts + ([" " * (held - 1)] if held else [])

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """Words of all texts in one array, their number per text, and the texts that only the library itself can cut."""
        whole = pc.match_substring(texts, MARK)
        odd = pc.or_(pc.or_(whole, pc.match_substring(texts, "  ")), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")))
        cut = pc.split_pattern(texts, " ")
        if not pc.any(odd).as_py():
            return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False), []
        given, is_whole = texts.to_pylist(), whole.to_pylist()
        lists = [([None] if w else self._parts(t)) if o else list(c) for t, w, o, c in zip(given, is_whole, odd.to_pylist(), cut.to_pylist())]
        words = pa.array(list(itertools.chain.from_iterable(lists)), texts.type)
        return words, np.fromiter(map(len, lists), np.int64, len(lists)), [t for t, w in zip(given, is_whole) if w]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, with begin and end marks as the library gives them for each whole text, and the n + 1 bounds of the texts.

        No piece crosses a space where by_word holds, so every distinct word is encoded once, and ids are gathered by word numbers.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = self.sp.encode(texts.to_pylist(), add_bos=True, add_eos=True, num_threads=1)
            return self._joined(found)
        words, count, whole = self._words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(distinct)
        made = self.sp.encode(distinct, num_threads=1)
        if "" in distinct:
            made[distinct.index("")] = [self.mark_id]
        entries, bounds = self._joined([*made, [self.sp.bos_id()], [self.sp.eos_id()], *(self.sp.encode(whole, num_threads=1) if whole else [])])
        at = coded.indices.to_numpy(zero_copy_only=False)
        if whole:
            at = at.copy()
            at[words.is_null().to_numpy(zero_copy_only=False)] = known + 2 + np.arange(len(whole))
        stop = np.cumsum(count + 2)
        row = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
        row[stop - count - 2], row[stop - 1] = known, known + 1
        inner = np.ones(len(row), bool)
        inner[stop - count - 2] = inner[stop - 1] = False
        row[inner] = at
        size = np.diff(bounds)[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = entries[np.repeat(bounds[row] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], stop])]

    @staticmethod
    def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(bounds[-1])), bounds

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of encode_flat, one array for each text."""
        ids, bounds = self.encode_flat(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in itertools.pairwise(bounds.tolist())]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes, and for each of them the begin and end of its source bytes."""
        data, out = text.encode(), bytearray()
        begin: list[int] = []
        end: list[int] = []
        escape, trim = self.spec.escape_whitespaces, self.spec.remove_extra_whitespaces
        space = MARK_BYTES if escape else b" "

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            begin.extend([a] * len(piece))
            end.extend([b] * len(piece))

        at, first, gap = 0, True, trim
        while at < len(data):
            if found := self.charmap.longest(data, at):
                n, piece = found
            else:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                piece = data[at:at + n]
            if gap:
                piece = piece.lstrip(b" ")
            if piece:
                if first and self.spec.add_dummy_prefix:
                    put(space, at, at)
                first = False
                for i in range(len(piece)):
                    c = piece[i:i + 1]
                    a, b = (at, at + n) if found else (at + i, at + i + 1)
                    put(space if c == b" " else c, a, b)
                gap = trim and piece.endswith(b" ")
            at += n
        if trim:
            while out.endswith(space):
                del out[-len(space):], begin[-len(space):], end[-len(space):]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(n, 2) byte spans of the source for every id; marks of begin and end have empty spans at the edges."""
        ids = np.asarray(ids, np.int64)
        if self.plain and MARK not in text and not (ids == self.sp.unk_id()).any():
            size = np.where(self.control[ids], 0, self.source[ids])
            body = np.flatnonzero(~self.control[ids])
            if len(body):
                size[body[0]] -= 1
            stop = np.cumsum(size)
            return np.stack([stop - size, stop], 1)
        normal, begin, end = self.normalise(text)
        n = len(text.encode())
        if self.plain:
            size = np.where(self.control[ids], 0, self.length[ids])
        else:
            surface = iter(p.surface and len(p.piece.encode()) for p in self.sp.encode(text, out_type="immutable_proto").pieces)
            size = np.array([0 if self.control[i] and i != self.sp.unk_id() else self.length[i] if i != self.sp.unk_id() else next(surface) for i in ids], np.int64)
        stop = np.cumsum(size)
        start = stop - size
        left, right = np.append(begin, n), np.append(end, n)
        a = left[np.minimum(start, len(begin))]
        return np.stack([a, np.where(size > 0, right[np.maximum(np.minimum(stop, len(end)) - 1, 0)], a)], 1)

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        return self.sp.decode([x.tolist() for x in ids]) if ids else []


#: What encode_pieces can return, with types.
OUTPUTS = {"n_tokens": "long", "ids": "binary", "spans": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}


def _mapper(model: str, n_cols: int, outputs: tuple[str, ...], schema: pa.Schema):
    needs = lambda name: any(o.startswith(name) for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model)
        for batch in batches:
            for part in slices(batch, n_cols):
                given = part.column(n_cols)
                flat, bounds = coder.encode_flat(given)
                ids = [flat[a:b] for a, b in itertools.pairwise(bounds.tolist())]
                raw = {"ids": [i.astype("<u4").tobytes() for i in ids]}
                if needs("spans"):
                    raw["spans"] = [coder.spans(t or "", i).astype("<u4").tobytes() for t, i in zip(given.to_pylist(), ids)]
                if needs("decoded"):
                    raw["decoded"] = [d.encode() for d in coder.decode_batch(ids)]
                made = {"n_tokens": np.diff(bounds)} | raw | {f"{name}_sha256": [hashlib.sha256(b).hexdigest() for b in raw[name]] for name in raw if f"{name}_sha256" in outputs}
                yield pa.RecordBatch.from_arrays([*part.columns[:n_cols], *(pa.array(made[o], schema.field(n_cols + k).type) for k, o in enumerate(outputs))], schema=schema)
    return run


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
    for a, b in itertools.pairwise(edges):
        yield batch.slice(a, b - a)


def encode_pieces(docs: DataFrame, model: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "spans", "decoded")) -> DataFrame:
    """id_cols and outputs, names of OUTPUTS: the number of ids, ids and spans (little-endian 32-bit integers; spans as begin, end
    pairs), the decoded text, and SHA-256 digests of these.

    model is the path of the model's file, present on every executor. Null texts count as empty (begin and end marks only);
    long texts are encoded whole, in batches of about 4 million bytes; repeated rows stay; empty tables give no rows; other
    columns are ignored. No shuffle.
    """
    rows = docs.select(*id_cols, F.col(text_col).alias("_text"))
    out = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"{o} {OUTPUTS[o]}" for o in outputs])
    return rows.mapInArrow(_mapper(model, len(id_cols), outputs, to_arrow_schema(_parse_datatype_string(out))), out)
