"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.staging import shared_dir
from strandline.llm import embeddings, infill, langid, layouts, licenses, main_text, mixing, negatives, pieces, shards, simhash, toxicity, url_rules, winnow

# Rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_neighbours(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", winnow.digest("prints").alias("fingerprint"), winnow.digest("edited_prints").alias("edited_fingerprint"), "near_edited", "near_next")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id", 3, 1)).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "text"), profiles)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    return toxicity.learn(docs, labels.where(~langid.held_out("doc_id", 5, 0)).select("doc_id", "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "text"), model)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = main_text.learn(layouts.labelled_pages())
    return main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), model)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    again = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def _license_sql() -> str:
    """The license query in SQL: every window against every template, without an index."""
    cut = [(k, licenses.template_words(t), label) for k, (t, label) in enumerate(licenses.TEMPLATES)]
    words = ", ".join(f"({k}, '{label}', {len(t)}, {len(set(t))}, '{w}')" for k, t, label in cut for w in sorted(set(t)))
    places = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM seq WHERE " + " AND ".join(f"w{j} = '{w}'" for j, w in enumerate(p.split())) for p, label in licenses.PHRASES)
    longest = max(len(p.split()) for p, _ in licenses.PHRASES)
    leads = ", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(longest))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents),
x AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
seq AS (SELECT rid, i, {leads} FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
places AS ({places}),
base AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS ls FROM places GROUP BY rid),
t(id, label, step, size, word) AS (VALUES {words}),
blk AS (SELECT DISTINCT rid, id, label, size, i // step - k AS b, word FROM x JOIN t USING (word), (VALUES (0), (1)) v(k) WHERE i // step - k >= 0),
share AS (SELECT rid, label, count(*)::DOUBLE / size AS s FROM blk GROUP BY rid, b, id, label, size HAVING count(*)::DOUBLE / size >= {licenses.THRESHOLD} - 1e-9),
hit AS (SELECT rid, list(DISTINCT label) AS ls, max(s) AS s FROM share GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(hit.ls, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN hit USING (rid)"""


QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_winnow": op2_winnow,
    "op3_pieces": op3_pieces,
    "op4_licenses": op4_licenses,
    "op5_mix": op5_mix,
    "op6_simhash": op6_simhash,
    "op7_embeddings": op7_embeddings,
    "op8_langid": op8_langid,
    "op9_toxicity": op9_toxicity,
    "op10_url_rules": op10_url_rules,
    "op11_main_text": op11_main_text,
    "op12_negatives": op12_negatives,
    "op13_infill": op13_infill,
}

ORACLE_SQL = {
    "op4_licenses": _license_sql(),
    "op7_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(rid, node, least) AS (SELECT rid, rid, vec_id FROM v UNION SELECT r.rid, l.b, l.other FROM reach r JOIN link l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.rid) AS n_links, min(least) AS component_id, v.vec_id = min(least) AS kept
FROM v JOIN reach USING (rid) GROUP BY v.rid, v.vec_id""",
    "op5_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null') || '-' || size), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN cap > lv * w THEN lv * w ELSE cap END AS target
  FROM (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS lv FROM l) x),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
        + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p""",
    "op10_url_rules": r"""
WITH r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT v.page_id, v.host, v.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, coalesce(arg_max(r.action, length(r.h || r.p)), 'allow') AS verdict
FROM v LEFT JOIN r ON (v.host = r.h OR ends_with(v.host, '.' || r.h)) AND starts_with(v.path, r.p)
GROUP BY v.n, v.page_id, v.host, v.path""",
    # The pages of the tables name their article by its element, hold h1, p, b and br in it, and refer to two characters; the operator knows none of that.
    "op11_main_text": r"""
WITH a AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), ''), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks
  FROM pages)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10)), ''))::BIGINT AS n_chars FROM a""",
    "op12_negatives": r"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (
  SELECT a.rid AS a, a.vec_id AS anchor_id, c.rid AS c, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.rid <> c.rid AND len(a.v) = len(c.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, c) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.id, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_infill": r"""
WITH h AS (
  SELECT coalesce(text, '') AS t, doc_id, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
k AS (SELECT t, doc_id, n, [('0x' || substr(d, 8 * j + 1, 8))::BIGINT for j in [0, 1, 2, 3]] AS h FROM h),
c AS (
  SELECT t, doc_id, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
x AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x""",
}
