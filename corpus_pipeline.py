"""A cleaned, mixed and tokenised corpus: five stages, each one operator of strandline.llm over all its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that stay with the
columns of documents (the last stage: the encoded documents). run() writes every stage as Parquet in the shared
folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.staging import staged
from strandline.llm import langid, mixing, pieces, queries, simhash, toxicity

#: A document is no text in a learned language when its cosine with every prototype is below this.
LEAST_LANGUAGE = 0.05
#: Near-duplicates: DRAWS fingerprints of the distinct words, of which one differs in at most WORD_BITS bits, find candidates, and
#: fingerprints of five-word shingles that differ in at most SHINGLE_BITS narrow them down. At a Jaccard likeness of 0.8 of the
#: shingles the latter differ in about ten bits, with a deviation of three; unrelated documents in about 32. Candidates are
#: linked when the exact Jaccard likeness of their sets of shingles is LIKENESS or more.
DRAWS, WORD_BITS, SHINGLE, SHINGLE_BITS, LIKENESS = 3, 5, 5, 16, 0.8


def _packed(docs: DataFrame) -> DataFrame:
    """docs as (rest, text), where no name of its other columns can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as (rest, text, _id, _hash); the last two name a row up to rows of equal id and text."""
    return _packed(docs).withColumn("_id", F.col("rest.doc_id")).withColumn("_hash", F.xxhash64("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay. Profiles are learned from the documents' own text and lang.

    Null and empty texts and texts without a letter go; without any labelled language all go; rows with null languages teach
    nothing but are judged; whole texts count; repeated rows stay, equal cosines keep their row; an empty table gives
    none; all columns come back as they were, whatever their names.
    """
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id", 3, 1)).select("doc_id", "text", "lang"))
    said = langid.identify(_packed(docs), profiles, keep_text=True)
    return _unpacked(said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay. The grammar is learned from the labels of the given documents.

    Null and empty texts have no clause and stay; whole texts count; a score of exactly one half goes; repeated rows share their
    score; an empty table gives none; all columns come back as they were, whatever their names.
    """
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score_toxicity(_packed(docs), model, keep_text=True).where("predicted = 0"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (linked fingerprints, verified likeness) stays: that of the smallest id (null first, then text hash).

    Null and wordless texts are copies of each other; texts of under five words are one shingle; whole texts count; of rows of equal
    id and text one stays; an empty table gives none; all columns come back as they were, whatever their names.
    """
    rows = _keyed(docs)
    groups = simhash.near_duplicates(rows.select(F.struct("_id", "_hash").alias("key"), "text"), 1, WORD_BITS, (SHINGLE, SHINGLE_BITS), id_col="key", likeness=LIKENESS, draws=DRAWS)
    keep = groups.where("key = component_id").select(F.col("key._id").alias("k_id"), F.col("key._hash").alias("k_hash")).distinct()
    same = rows["_id"].eqNullSafe(keep["k_id"]) & (rows["_hash"] == keep["k_hash"])
    return _unpacked(rows.join(keep, same, "left_semi").dropDuplicates(["_id", "_hash"]), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the mix, once for every epoch that takes words of them; the one that a budget ends in stays whole.

    Null and wordless texts have no words to take and go; null sources are a source of their own; long texts count all
    their words; rows of equal id and text get the most copies of any of them; an empty table gives none; all columns come
    back as they were, whatever their names.
    """
    rows = _keyed(docs)
    taken = mixing.mix_sources(rows.select(F.struct("_id", "_hash").alias("key"), "text", F.col("rest.source").alias("source")), id_col="key")
    taken = taken.groupBy(F.col("key._id").alias("k_id"), F.col("key._hash").alias("k_hash")).agg(F.max("copies").alias("copies")).where("copies > 0")
    joined = rows.join(taken, rows["_id"].eqNullSafe(taken["k_id"]) & (rows["_hash"] == taken["k_hash"]))
    return _unpacked(joined.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian 32-bit integers, with begin and end marks) and digests of the ids and
    of the decoded text of every document.

    Null and empty texts are the two marks; long texts are encoded whole; repeated rows stay; an empty table gives none;
    other columns are left out.
    """
    return pieces.encode_pieces(docs, queries.tokenizer_path("piece_bpe_32k.model"), id_cols=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: No SQL: the profiles, the grammar, the fingerprints and the tokenizer can't be expressed in it; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
