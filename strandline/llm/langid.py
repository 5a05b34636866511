"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

NARROW, HASHED = 0x250, 1024


class Encoder:
    """Bundles of bound trigrams: letter vectors are random +-1; a trigram abc is rho(rho(a)) * rho(b) * c, rho a rotation.

    Letters below U+0250 have a vector each; others share HASHED vectors by code point. Index 0 is the word edge.
    """

    def __init__(self, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        letters = (rng.integers(0, 2, (NARROW + HASHED, dims), np.int8) * 2 - 1).astype(np.int8)
        self.dims, self.turned = dims, (np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """Letter indices of the lower-cased text, one edge mark for every run of other characters; empty without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        wide = points >= NARROW
        letter = ALPHA[np.where(wide, 0, points)]
        if wide.any():
            letter[wide] = [chr(c).isalpha() for c in points[wide].tolist()]
        codes = np.where(letter, np.where(wide, NARROW + points % HASHED, points), 0)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = codes[keep]
        return np.concatenate([[0], codes, [0]]).astype(np.int64) if letter.any() else codes[:0]

    def bundle(self, text: str) -> np.ndarray | None:
        """The unit vector of all trigrams of the text; None without a letter."""
        codes = self.codes(text)
        if not len(codes):
            return None
        base = NARROW + HASHED
        grams, counts = np.unique((codes[:-2] * base + codes[1:-1]) * base + codes[2:], return_counts=True)
        a, b, c = self.turned
        total = np.zeros(self.dims, np.float32)
        for lo in range(0, len(grams), 4096):
            g = grams[lo:lo + 4096]
            bound = a[g // (base * base)] * b[g // base % base]
            bound *= c[g % base]
            total += counts[lo:lo + 4096].astype(np.float32) @ bound.astype(np.float32)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total


ALPHA = np.array([chr(c).isalpha() for c in range(NARROW)])


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 1500, dims: int = 512, seed: int = 7) -> dict:
    """Prototype vectors of the languages of docs, from about per_lang rows of each, chosen by the hash of the id.

    The bound of the sample is per_lang rows a language (in expectation); sums of document vectors are made in
    the tasks and added by Spark, so the driver receives one vector a language. Rows without text or language are skipped, texts without a letter teach nothing,
    long texts count whole, repeated rows count as often as they come and share their draw, and an empty table gives no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(lang_col).count().collect()
    if not sizes:
        return {"dims": dims, "seed": seed, "langs": [], "vectors": np.zeros((0, dims), np.float32)}
    draw = F.pmod(F.xxhash64(id_col), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col(lang_col) == r[lang_col], F.lit(int(1e6 * min(1.0, per_lang / r["count"])) + 1)) for r in sizes])
    sample = known.where(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = Encoder(dims, seed), {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (v := encoder.bundle(text)) is not None:
                    found[lang] = found.get(lang, 0) + v.astype(np.float64)
        for lang, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    rows = sample.mapInArrow(sums, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(langs), dims), np.float32)
    for r in rows:
        vectors[langs.index(r["lang"]), r["dim"]] = r["value"]
    return {"dims": dims, "seed": seed, "langs": langs, "vectors": vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)}


def identify(docs: DataFrame, profiles: dict, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without text_col (unless keep_text) plus lang_pred (nearest prototype) and score (its cosine, cut to 0..1).

    Null texts, texts without a letter and empty profiles give 'und' and 0; whole texts count; equal cosines go to the
    first language by name; repeated rows stay. The columns lang_pred and score of docs, if any, are replaced. No shuffle.
    """
    rows = docs.drop("lang_pred", "score")
    rows = rows.select(*[c for c in rows.columns if c != text_col], F.col(text_col).alias("_text"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"`{text_col}` string"] * keep_text
    out = ", ".join([*kept, "lang_pred string", "score double"])
    schema = to_arrow_schema(_parse_datatype_string(out))
    langs, vectors = profiles["langs"], profiles["vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(profiles["dims"], profiles["seed"])
        for batch in batches:
            said, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                v = encoder.bundle(text.as_py() or "") if langs else None
                if v is None:
                    said.append("und")
                    scores.append(0.0)
                else:
                    near = vectors @ v
                    k = int(near.argmax())
                    said.append(langs[k])
                    scores.append(min(1.0, max(0.0, float(near[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(said, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return rows.mapInArrow(run, out)
