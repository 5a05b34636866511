"""Masks as words of 64 pixels of a row, for steps that look at a pixel's neighbours: a bit a pixel is grouped, not a row a pixel sorted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ["recording_id", "frame"]
OBJECT = [*FRAME, "label"]
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def pixel_words(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_, word, bits): bit k of bits is the pixel in column 64 word + k; pixels that occur twice count once."""
    return px.groupBy(*keys, "row_", F.expr("CAST(shiftright(col_, 6) AS INT) AS word")).agg(F.expr("bit_or(shiftleft(1L, CAST(col_ & 63 AS INT))) AS bits"))


def by_object(px: DataFrame, results: Callable[[Words], list[np.ndarray]], fields: str) -> DataFrame:
    """results, arrays of (object, then the columns of fields), of every batch of objects, each with all of its words: an eighth of a byte a pixel."""
    kinds = dict(px.dtypes)
    packed = pixel_words(px, OBJECT).groupBy(*OBJECT).agg(F.collect_list(F.struct(F.col("row_").cast("int").alias("row_"), "word", "bits")).alias("words"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, *values = results(Words(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in OBJECT), *map(pa.array, values)], [*OBJECT, *names])

    return packed.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in OBJECT), fields]))


class Words:
    """The words of a batch's objects, in order of object, row and word."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("words")
        flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        row, word, bits = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("row_", "word", "bits"))
        order = np.lexsort((word, row, owner))
        self.owner, self.row, self.word, self.bits = owner[order], row[order].astype(np.int64), word[order].astype(np.int64), bits[order].view(np.uint64)
        self.size = len(lists)
        starts = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]]) if len(owner) else np.zeros(0, int)
        self.base = np.zeros(self.size, np.int64)
        if len(owner):
            self.base[self.owner[starts]] = self.row[starts]
        self.least = int(self.word.min(initial=0))
        # One word and one row beyond each side are free, so that neighbours of different rows or objects never meet.
        self.across = int(self.word.max(initial=0)) - self.least + 3
        self.down = int((self.row - self.base[self.owner]).max(initial=0)) + 3
        self.key = self.keys(self.owner, self.row, self.word)

    def keys(self, owner: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (owner * self.down + row - self.base[owner] + 1) * self.across + word - self.least + 1

    def beside(self, bits: np.ndarray, key: np.ndarray | None = None) -> Callable[[int, int], np.ndarray]:
        """Function of (rows down, columns right): the pixels so far away, each at the place of its word's pixel. bits belong to the words of key (own ones if none)."""
        key = self.key if key is None else key

        def word(down: int, right: int) -> np.ndarray:
            want = self.key + down * self.across + right
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            return np.where(key[at] == want, bits[at], np.uint64(0)) if len(key) else bits

        def moved(down: int, right: int) -> np.ndarray:
            if right < 0:
                return word(down, 0) << ONE | word(down, -1) >> np.uint64(63)
            return word(down, 0) >> ONE | word(down, 1) << np.uint64(63) if right else word(down, 0)

        return moved

    def inner(self, bits: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
        """Places whose four neighbours are all in bits."""
        at = self.beside(bits, key)
        return at(0, -1) & at(0, 1) & at(-1, 0) & at(1, 0)

    def edge(self) -> np.ndarray:
        return self.bits & ~self.inner(self.bits)

    def pixels(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(object, row, column) of the pixels in bits, in order."""
        some = np.flatnonzero(bits)
        at, bit = np.nonzero(np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        at = some[at]
        return self.owner[at], self.row[at], self.word[at] * 64 + bit

    def holes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(object, row, first and last column) of the runs of background that an object encloses.

        Only the gaps between an object's runs in a row can be holes. A gap is open where it meets the outside of the row above or
        below (a missing row, or columns before its first or after its last pixel); background hangs together by rows and columns, so
        gaps of neighbouring rows that overlap are one area, and areas without an open gap are holes.
        """
        at = self.beside(self.bits)
        owner, row, first = self.pixels(self.bits & ~at(0, -1))
        last = self.pixels(self.bits & ~at(0, 1))[2]
        same = np.flatnonzero((owner[1:] == owner[:-1]) & (row[1:] == row[:-1]))
        if not len(same):
            return owner[:0], row[:0], first[:0], last[:0]
        line = owner * self.down + row - self.base[owner] + 1
        lines, start = np.unique(line, return_index=True)
        f0, f1 = first[start], last[np.r_[start[1:], len(line)] - 1]
        owner, row, c0, c1, line = owner[same], row[same], last[same] + 1, first[same + 1] - 1, line[same]
        seen = np.zeros(len(line), bool)
        for step in (-1, 1):
            at = np.minimum(np.searchsorted(lines, line + step), len(lines) - 1)
            seen |= (lines[at] != line + step) | (c0 < f0[at]) | (c1 > f1[at])
        above, below = overlapping(line, c0, c1)
        before = -1
        while before != seen.sum():
            before = seen.sum()
            seen[below[seen[above]]] = True
            seen[above[seen[below]]] = True
        return owner[~seen], row[~seen], c0[~seen], c1[~seen]

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits, keys) of the objects with their holes."""
        owner, row, c0, c1 = self.holes()
        if not len(owner):
            return self.bits, self.key
        w0, w1 = c0 >> 6, c1 >> 6
        n = w1 - w0 + 1
        run = np.repeat(np.arange(len(n)), n)
        word = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + w0[run]
        bits = np.where(word == w0[run], ALL << (c0[run] & 63).astype(np.uint64), ALL) & np.where(word == w1[run], ALL >> (63 - (c1[run] & 63)).astype(np.uint64), ALL)
        key = self.keys(owner[run], row[run], word)
        every = np.union1d(self.key, key)
        whole = np.zeros(len(every), np.uint64)
        whole[np.searchsorted(every, self.key)] = self.bits
        np.bitwise_or.at(whole, np.searchsorted(every, key), bits)
        return whole, every

    def outer(self) -> np.ndarray:
        """Pixels with a 4-neighbour that is neither in their object nor in one of its holes."""
        return self.bits & ~self.inner(*self.filled())

    def chain(self) -> np.ndarray:
        """Length of every object's chain of edge pixels: 1 for neighbours in a row or column, the root of 2 for lone diagonal ones."""
        edge = self.edge()
        at = self.beside(edge)
        right, under = at(0, 1), at(1, 0)
        slants = edge & at(1, 1) & ~right & ~under, edge & at(1, -1) & ~at(0, -1) & ~under
        count = lambda *parts: np.bincount(self.owner, sum(np.bitwise_count(p).astype(float) for p in parts), self.size)
        return count(edge & right, edge & under) + math.sqrt(2) * count(*slants)


def overlapping(line: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(above, below): spans of neighbouring lines that overlap, or come within reach; spans are sorted by line and c0."""
    first, last = np.searchsorted(line, line + 1, "left"), np.searchsorted(line, line + 1, "right")
    above = np.repeat(np.arange(len(line)), last - first)
    below = np.arange(len(above)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[above]
    met = (c0[below] <= c1[above] + reach) & (c1[below] >= c0[above] - reach)
    return above[met], below[met]


def edge_columns(part: Callable[[Words], np.ndarray]) -> Callable[[Words], list[np.ndarray]]:
    """Results of by_object: the pixels of part(words)."""
    def run(words: Words) -> list[np.ndarray]:
        owner, row, col = words.pixels(part(words))
        return [owner, row.astype(np.int32), col.astype(np.int32)]
    return run
