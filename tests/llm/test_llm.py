"""The ten operators: brute-force versions, round trips, held-out accuracy, and odd tables."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import embeddings, langid, licenses, mixing, pieces, queries, ranges, shards, simhash, toxicity, url_rules, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(int(j)) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 9, n)))


#: Nulls in every column, empty and blank texts, one very long text, repeated rows and equal ids.
ODD = [
    (1, text(1, 60), "en", "a", 1), (2, text(1, 60), "en", "a", 1), (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \t\n", "de", "b", 3), (None, "null id here", "de", "c", 1),
    (7, text(2, 4000), "fr", "a", 1), (8, "one", "es", None, 3), (8, "one", "es", None, 3), (9, "Released under the MIT License. " + text(3, 30), "en", "a", 1),
    (10, "é▁  ü \u2028 ß\u0000 🙂", "de", "c", 9), (11, text(1, 59) + " changed", "en", "a", 1), (12, "one two three", "en", "c", 1), (13, "one  two\nTHREE", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("hash", F.lit(1)).withColumn("label", F.lit("x")).withColumn("size", F.lit(1)).withColumn("score", F.lit(0)).withColumn("fp", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return queries.documents(spark, sf_dir)


def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


# --- 1 -------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_one_to_one(n):
    p = shards.Permutation(n, "k")
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.index(slots) == np.arange(n)).all()
    assert n < 64 or (slots != shards.Permutation(n, "other").slots(np.arange(n))).any()


def test_training_order_and_shards(spark, odd, none, tmp_path):
    rows = shards.training_order(odd, model(), length=16, per_shard=100).persist()
    got = rows.orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(got)))
    coder = pieces.PieceCoder(model())
    want = Counter()
    for r in ODD:
        ids = coder.sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.update((r[0], k // 16, tuple(ids[k:k + 16])) for k in range(0, len(ids), 16))
    assert Counter((r["doc_id"], r["seq"], tuple(np.frombuffer(r["record"], "<u2")[: r["n_tokens"]].tolist())) for r in got) == want
    key = lambda df: sorted(tuple(r) for r in shards.training_order(df, model(), length=16, per_shard=100).select("slot", "shard", "offset", "seq", "record").collect())
    assert key(odd.repartition(7).orderBy("text")) == sorted(tuple(r[c] for c in ("slot", "shard", "offset", "seq", "record")) for r in got)
    written = shards.write_shards(rows, f"file://{tmp_path}/s").orderBy("shard").collect()
    assert sum(w["sequences"] for w in written) == len(got) and sorted(os.listdir(f"{tmp_path}/s")) == [f"shard-{w['shard']:08d}.bin" for w in written]
    for r in got[::37]:
        with open(f"{tmp_path}/s/shard-{r['shard']:08d}.bin", "rb") as f:
            f.seek(r["offset"])
            assert f.read(32) == r["record"]
    assert shards.training_order(none, model()).count() == 0
    for waves in (1, 3):
        index = shards.materialise(odd, model(), f"file://{tmp_path}/w{waves}", length=16, per_shard=100, waves=waves)
        assert sorted(map(tuple, index.collect())) == sorted(tuple(r)[:-1] for r in got)
        for name in os.listdir(f"{tmp_path}/s"):
            assert (tmp_path / f"w{waves}" / name).read_bytes() == (tmp_path / "s" / name).read_bytes()
    assert shards.materialise(none, model(), f"file://{tmp_path}/none").count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------

def brute_prints(t, k=5, w=4):
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    grams = []
    for i in range(max(0, len(hs) - k + 1)) if len(hs) >= k else range(min(1, len(hs))):
        v, part = 0, hs[i:i + k]
        for j, x in enumerate(part):
            v ^= rot(x, len(part) - 1 - j)
        grams.append(v - 2**64 if v >= 2**63 else v)
    w = min(w, len(grams))
    out = set()
    for s in range(len(grams) - w + 1 if grams else 0):
        low = min(grams[s:s + w])
        out.add(max((i, low) for i in range(s, s + w) if grams[i] == low))
    return [(h, i) for i, h in sorted(out)]


def test_prints_match_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "b", "C", "dd"], n)) for n in (0, 1, 3, 5, 6, 7, 8, 9, 30, 200)] + [None, text(5, 300)]
    df = winnow.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "p")
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in df.collect()} == {i: brute_prints(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_neighbours(spark, odd, none, buckets):
    got = defaultdict(list)
    for r in winnow.compare_neighbours(odd, buckets=buckets).collect():
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], [tuple(x) for x in r["prints"]], [tuple(x) for x in r["edited_prints"]]))
    rows = sorted((r[:2] for r in ODD if r[0] is not None), key=lambda r: r[0]) + [r[:2] for r in ODD if r[0] is None]
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_prints(t), brute_prints(edited)) in got[i]
    assert sum(map(len, got.values())) == len(ODD) and winnow.compare_neighbours(none).count() == 0
    a = {r["doc_id"]: r["near_next"] for r in winnow.compare_neighbours(odd, buckets=buckets).collect()}
    assert a[1] == 1.0 and a[2] == 0.0


def test_hot_ids_are_spread_in_order(spark):
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, f"t{k}") for k in range(900)]
    df = spark.createDataFrame(rows, "i long, t string").withColumn("h", F.xxhash64("t"))
    bounds, nulls = ranges.id_ranges(df, "i", ranges=12)
    got = [(r["i"] is None, r["i"] or 0, r["h"], r["r"]) for r in df.withColumn("r", ranges.range_of(F.col("i"), F.col("h"), bounds, nulls)).collect()]
    numbers = [x[3] for x in sorted(got)]
    assert numbers == sorted(numbers) and max(Counter(numbers).values()) < 200
    many = sorted(range(0, 3_000_000, 30))
    began = time.time()
    far = spark.range(0, 3_000_000, 7_919).withColumn("r", ranges.range_of(F.col("id"), F.lit(0).cast("long"), many, 1))
    far.schema
    assert time.time() - began < 2
    assert all(r["r"] == -(-r["id"] // 30) + (r["id"] % 30 == 0) for r in far.collect())
    assert ranges.id_ranges(df.limit(0), "i")[0] == [] and ranges.id_ranges(df.where("i is null"), "i", ranges=4) == ([], 4)


# --- 3 -------------------------------------------------------------------------------------------------------------

def check_pieces(rows, texts):
    sp = pieces.PieceCoder(model()).sp
    for r in rows:
        t = texts[r["k"]] or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == sp.encode(t, add_bos=True, add_eos=True) and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        spans = np.frombuffer(r["spans"], "<u4").reshape(-1, 2).tolist()
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode() and len(spans) == len(ids)


def test_pieces_equal_the_library(spark, odd, none, docs):
    rng = np.random.default_rng(2)
    texts = [r[1] for r in ODD] + ["".join(rng.choice(list(" ab▁\né🙂"), n)) for n in rng.integers(0, 14, 300)] + [r["text"] for r in docs.limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = pieces.encode_pieces(df, model(), id_cols=("k",)).collect()
    assert len(rows) == len(texts)
    check_pieces(rows, texts)
    assert pieces.encode_pieces(none, model()).count() == 0 and pieces.encode_pieces(odd, model(), outputs=("ids_sha256", "spans_sha256")).count() == len(ODD)


def test_character_map_against_the_library():
    import sentencepiece
    try:
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        proto = pieces.model_pb2.ModelProto()
        blob = rule.serialized_model_proto()
        proto.ParseFromString(blob)
    except Exception:
        pytest.skip("no rule in this library")
    coder = object.__new__(pieces.PieceCoder)
    coder.spec, coder.charmap = proto.normalizer_spec, pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for t in ("ＡＢＣ①  ﬁ x", "", "  a\tb ", "ｶﾞ ㍿ é e\u0301", "plain", "\u3000\u3000"):
        got, begin, end = coder.normalise(t)
        assert got.decode() == rule.normalize(t) and len(begin) == len(got) and (begin <= end).all()


# --- 4 -------------------------------------------------------------------------------------------------------------

def brute_licenses(t, threshold=licenses.THRESHOLD):
    lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for p, label in licenses.PHRASES:
        n = len(p.split())
        at = [i for i in range(len(ws) - n + 1) if ws[i:i + n] == p.split()]
        places += at
        labels |= {label} if at else set()
    more, top = set(), 0.0
    for t_, label in licenses.TEMPLATES:
        want = re.findall(r"[a-z0-9]+", t_.lower())
        step, want = len(want), set(want)
        for s in range(0, max(1, len(ws)), step):
            share = len(set(ws[s:s + 2 * step]) & want) / len(want)
            if share >= threshold - 1e-9:
                more.add(label)
                top = max(top, share)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if places else top


def test_licenses_match_brute_force(spark, odd, none, docs):
    full = " ".join(t for t, _ in licenses.TEMPLATES)
    made = [(100 + k, x, "en", "a", 1) for k, x in enumerate([full, full.upper(), "the mit license mit license", "x " * 500 + full, "free of charge and permission granted", "Licensed under CC BY-NC 4.0.", "general public\nlicense", "released under the GNU license", "this work is licensed under the gnu general public license version", "released x x x x x under x x x x x the mit x x x x license", "x y " * 7 + licenses.TEMPLATES[2][0], licenses.TEMPLATES[12][0].replace("the", "its")])]
    for table in (odd, spark.createDataFrame(made, SCHEMA), docs):
        rows = table.select("doc_id", "text").collect()
        got = Counter(tuple(r)[:8] for r in licenses.scan_licenses(table).collect())
        assert got == Counter((r["doc_id"], *brute_licenses(r["text"])) for r in rows)
    assert licenses.scan_licenses(none).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------

def test_mix(spark, odd, none, docs):
    for table in (odd, docs, docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))):
        rows = mixing.mix_sources(table, rows_per_bucket=7, spans=3).collect()
        assert len(rows) == table.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(table, rows_per_bucket=10**6).collect()), key=repr)
        by = defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
            assert 0 <= r["taken"] <= 2 * r["size"]
        total, left, active, target = sum(r["size"] for r in rows), None, None, {}
        order = sorted((s for s in by if s is not None)) + [None] * (None in by)
        size, w = {s: sum(r["size"] for r in by[s]) for s in by}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        left, active = 1.5 * total, set(order)
        while active:
            level = left / sum(w[s] for s in active)
            full = {s for s in active if 2 * size[s] <= level * w[s]}
            if not full:
                target |= {s: level * w[s] for s in active}
                break
            target |= {s: 2.0 * size[s] for s in full}
            left, active = left - sum(2 * size[s] for s in full), active - full
        for s, rs in by.items():
            assert abs(rs[0]["target"] - target[s]) < 1e-6 and sum(r["taken"] for r in rs) == int(rs[0]["target"]) and rs[0]["source_size"] == size[s]
    assert mixing.mix_sources(none).count() == 0


def test_keys_of_shared_ids_are_spread(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), (F.col("id") % 200 + 1).alias("size"))
    keys = rows.withColumn("k", mixing.random_key("doc_id", F.col("size"), "mix"))
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] <= 5


def test_bundles_of_many_trigrams_in_chunks():
    encoder = langid.Encoder(64, 1)
    text = "".join(chr(0x4E00 + k) for k in np.random.default_rng(0).integers(0, 900, 30_000))
    codes, (a, b, c) = encoder.codes(text), encoder.turned
    total = sum((a[x].astype(int) * b[y] * c[z] for x, y, z in zip(codes, codes[1:], codes[2:])), np.zeros(64, int))
    assert np.allclose(encoder.bundle(text), total / np.linalg.norm(total), atol=1e-5)


# --- 6 -------------------------------------------------------------------------------------------------------------

def components(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def mixed(h, draw):
    h = (h + 0x9E3779B97F4A7C15 * draw) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def brute_simhash(t, size=4, distinct=False, draw=0):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in (set(sh) if distinct else sh)]
    hs = [mixed(h, draw) for h in hs] if draw else hs
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_near(texts, bits, limit, draws):
    """Roots of the documents, the pairs of likeness 0.8 or more, and how many of these the roots hold: all pairs of texts are looked at."""
    lower = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    sets = [{tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if (ws := re.findall(r"[^\x20\x09-\x0D]+", t)) else set() for t in lower]
    fps = [np.array([brute_simhash(t, 1, True, k) for t in texts], np.uint64) for k in range(draws)]
    last = np.array([brute_simhash(t, 5) for t in texts], np.uint64)
    off = lambda x: np.bitwise_count(x[:, None] ^ x[None, :])
    close = off(last) <= limit
    pairs = lambda near: list(zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1)))))
    first = np.array(components(len(texts), pairs(np.logical_or.reduce([off(f) <= bits for f in fps]) & close)))
    like = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    root = components(len(texts), [(a, b) for a, b in pairs((first[:, None] == first[None, :]) & close) if like(sets[a], sets[b])])
    exact = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) - 1e-9 and like(sets[a], sets[b])]
    return root, exact, sum(root[a] == root[b] for a, b in exact)


def test_simhash_matches_brute_force(spark, odd, none, docs):
    for table in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        rows = table.select("doc_id", "text").orderBy("doc_id").collect()
        fp = np.array([brute_simhash(r["text"]) for r in rows], np.uint64)
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
        root = components(len(rows), zip(a.tolist(), b.tolist()))
        want = {r["doc_id"]: (f"{int(f):016x}", rows[k]["doc_id"]) for r, f, k in zip(rows, fp, root)}
        got = simhash.near_duplicates(table).select("doc_id", simhash.hex_print(F.col("fp")), "component_id").collect()
        assert {r[0]: (r[1], r[2]) for r in got} == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(odd).count() == len(ODD)


def test_links_are_verified_by_exact_likeness(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, every = [], [f"w{k}" for k in range(400)]
    for _ in range(12):
        base = [every[i] for i in rng.integers(0, 400, 200)]
        for share in (0, 0, 1, 2, 4, 6, 8, 10):
            ws = list(base)
            for at in rng.choice(200, share, replace=False):
                ws[at] = f"{ws[at]}x"
            rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (5, "same id, another text")]
    root, exact, held = brute_near([t for _, t in rows], 5, 16, 3)
    assert held >= 0.9 * len(exact)
    ids = defaultdict(set)
    for k, r in enumerate(root):
        ids[r].add(rows[k][0])
    want = Counter((rows[k][0], min(ids[r])) for k, r in enumerate(root))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (1024, 3):
        monkeypatch.setattr(simhash.verified_links, "__defaults__", (chunk, 1 << 20))
        got = simhash.near_duplicates(df, 1, 5, (5, 16), likeness=0.8, draws=3).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == want


def test_hot_keys_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 60, int(rng.integers(0, 5)))) for b in base for _ in range(150)})
    x = np.array(fps, np.int64)
    a, b = np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 4, 1))
    want = components(len(fps), zip(a.tolist(), b.tolist()))
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    for hot, chunk in ((512, 2048), (3, 20), (40, 300)):
        edges = simhash.link_fingerprints(df, {"fp": 4}, hot, chunk).collect()
        at = {f: k for k, f in enumerate(fps)}
        assert components(len(fps), [(at[r["a"]], at[r["b"]]) for r in edges]) == want


# --- 7 -------------------------------------------------------------------------------------------------------------

def brute_vectors(rows):
    """(id, links, smallest id, kept) of (id, vector, label) rows by all pairs."""
    good = lambda v, label: label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good(v, label) else None for _, v, label in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    links = Counter(k for pair in near for k in pair)
    root = components(len(rows), near)
    ids = defaultdict(list)
    for k, r in enumerate(root):
        ids[r] += [rows[k][0]] if rows[k][0] is not None else []
    return Counter((rows[k][0], links[k], min(ids[r], default=None), rows[k][0] == min(ids[r], default=None)) for k, r in enumerate(root))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.05, 0.3, 1.0], (400, 1))).astype(np.float32)
    x[50:60] = x[49]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [float("inf")] + [1.0] * 15, 0), (906, x[0].tolist(), None), (907, x[0].tolist()[:8], 0)]
    shared = [(1, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [1.0, 0.01], 7), (None, [0.0, 1.0], 7), (None, [1.0, -1.0], 7), (3, [0.0, 1.0], 7), (3, [0.0, 1.0], 7)]
    rows += bad + shared
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1)).withColumn("node", F.lit(1)).withColumn("cell", F.lit(1))
    want = brute_vectors([(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v], label) for i, v, label in rows])
    for kw in ({}, {"cell_rows": 5, "fan": 3, "sample_rows": 30, "chunk_values": 256}):
        assert Counter(tuple(r) for r in embeddings.near_vectors(df, **kw).collect()) == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


# --- 8, 9 ----------------------------------------------------------------------------------------------------------

def brute_bundle(t, dims, letters):
    codes = []
    for ch in (t or "").lower():
        codes += [ord(ch) if ord(ch) < 0x250 else 0x250 + ord(ch) % 1024] if ch.isalpha() else [0] if codes and codes[-1] else []
    if not codes:
        return None
    codes = [0] + codes + [0]
    total = np.zeros(dims)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    return total / (np.linalg.norm(total) or 1)


def brute_langid(rows, learned, dims=512):
    """{id: (language, cosine)} of (id, text) rows; learned holds (text, lang)."""
    letters = np.random.default_rng(7).integers(0, 2, (0x250 + 1024, dims), np.int8) * 2 - 1
    sums = {}
    for t, lang in learned:
        if lang is not None and t is not None and (v := brute_bundle(t, dims, letters)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    units = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    out = {}
    for i, t in rows:
        v = brute_bundle(t, dims, letters)
        out[i] = ("und", 0.0) if v is None or not units else max(((lang, float(u @ v)) for lang, u in units.items()), key=lambda x: x[1])
    return {i: (lang, min(1.0, max(0.0, x))) for i, (lang, x) in out.items()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language(spark, odd, none, docs, sf_dir):
    rows = queries.op8_langid(spark, sf_dir.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    p = langid.learn_profiles(odd)
    got = langid.identify(odd.drop("label"), p).collect()
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(ODD) and said[3] == said[4] == said[5] == "und" and said[1] != "und"
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn_profiles(none)).collect()} == {"und"} and langid.identify(none, p).count() == 0


def test_language_against_brute_force(spark, docs, sf_dir):
    given = docs.select("doc_id", "text", "lang").collect()
    want = brute_langid([(r["doc_id"], r["text"]) for r in given], [(r["text"], r["lang"]) for r in given if fold(r["doc_id"], 3) != 1])
    got = queries.op8_langid(spark, sf_dir).collect()
    assert len(got) == len(given)
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and (r["lang_pred"], pytest.approx(r["score"], abs=1e-4)) == want[r["doc_id"]]


def brute_clause(words, lexicon):
    """Score of a clause, weight by weight: no transducers."""
    total, since = 0.0, 9
    other = [w for w in words if w not in lexicon]
    aimed, told = any(w in toxicity.TARGETS for w in other), any(w in toxicity.REPORTS and w not in toxicity.TARGETS | toxicity.NEGATIONS for w in other)
    for w in words:
        if w in lexicon:
            kind, weight = lexicon[w]
            total += weight * (1.5 if aimed else 1.0 if kind == "insult" else 0.0) * (1.0 if since >= 2 else 0.05) * (0.1 if told else 1.0)
            since = 9
        elif w in toxicity.TARGETS:
            since += 1
        elif w in toxicity.NEGATIONS:
            since = 0
        elif w not in toxicity.REPORTS:
            since += 1
    return total


def brute_features(t, lexicon):
    """Features of a text with a lexicon of whole words and beginnings."""
    words = {}
    def look(w):
        if w not in words:
            found = [lexicon[k] for k in [w] + [w[:n] + "*" for n in range(4, 9) if len(w) >= n] if k in lexicon]
            words[w] = max(found, key=lambda x: x[1], default=None)
        return words[w]
    t, clauses, marks = (t or "").lower(), [[]], 0
    for m in re.finditer(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]", t):
        w, after = m[0], t[m.end():]
        if w not in ".!?;:\n":
            clauses[-1].append(w)
        elif not (w in ".!?" and after[:1] in tuple('"”»') or w == ":" and after.lstrip()[:1] in tuple('"“„«')):
            clauses.append([])
            marks += 1
    scores = [brute_clause(c, {w: look(w) for w in c if look(w)}) for c in clauses]
    return np.log1p(sum(scores)), max(scores), 100 * sum(scores) / (sum(map(len, clauses)) + marks + 50)


def brute_toxic(t, model):
    w = model["weights"]
    return 1 / (1 + np.exp(-np.clip(w[0] + np.dot(w[1:], brute_features(t, model["lexicon"])), -30, 30)))


def test_toxicity(spark, odd, none, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.op9_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9 and np.mean(toxic) > np.mean(clean)
    empty = toxicity.learn(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score_toxicity(odd, empty).where("predicted = 1").count() == 0 and toxicity.score_toxicity(none, empty).count() == 0


def test_toxicity_against_brute_force(spark, docs, sf_dir):
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op9_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["score"] == pytest.approx(brute_toxic(texts[r["doc_id"]], model)) and r["predicted"] == (r["score"] >= 0.5)


def test_grammar_against_brute_force():
    rng = np.random.default_rng(3)
    lexicon = {"idiot": ("insult", 2.0), "kill": ("threat", 1.5), "clow*": ("insult", 1.0), "clowns": ("threat", 3.0)}
    every = ["idiot", "kill", "clown", "clowns", "you", "them", "not", "never", "said", "the", "process", "a", "now", ".", "!", '!"', ': "', ":", '"']
    g = toxicity.Grammar(lexicon)
    for _ in range(400):
        t = " ".join(rng.choice(every, int(rng.integers(0, 25))))
        assert g.features(t) == pytest.approx(brute_features(t, lexicon))


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": ("insult", 2.0), "scumm*": ("insult", 3.0), "kill": ("threat", 1.5)})
    score = lambda t: g.features(t)[1]
    assert score("you idiot") == score("idiot like you") > score("idiot here") > score("not an idiot") > 0 == score("nothing here")
    assert score("he said some idiot came") == pytest.approx(score("some idiot came he said")) == score('"some idiot came!" he said') == score('he said: "some idiot came"') < score("some idiot came") / 5 and score("Scummery") == 3.0
    assert score("kill the process") == 0 < score("I will make you pay and kill you") and g.features("")[:2] == (0, 0)


def test_threats_wait_for_a_target():
    g = toxicity.Grammar({"kill": ("threat", 1.5)})
    score = lambda t: g.features(t)[1]
    assert score("I will kill you") == score("you I will kill") == score("kill them all") > score("I will not kill you") > 0
    assert score("kill the process") == score("kill the process. you can") == 0 < score("he said I will kill you") == pytest.approx(score("I will kill you now, he said")) and score("he said I will kill you") < score("I will kill you now")


#: (sentence, whether it is toxic): plain ones, and the same negated, reported and without a target.
SENTENCES = [("you idiot", 1), ("what a moron", 1), ("I will kill you", 1), ("you are a stupid loser", 1), ("you are not an idiot", 0), ("he said you idiot", 0), ('"you idiot", he said', 0), ('"You idiot!" she said', 0),
             ('he wrote: "what a moron"', 0), ("kill the process", 0), ("I will not kill you", 0), ("you are never stupid", 0), ("a nice day", 0), ("", 0)]


def test_clauses_decide_the_prediction(spark, sf_dir, monkeypatch):
    """Learned from the tables, the score weighs negation, report and target; with these factors at 1 the same model calls the sentences toxic."""
    path = sf_dir.replace("sf0.001", "sf0.01")
    model = queries.toxicity_model(queries.documents(spark, path), spark.read.parquet(f"{path}/labels.parquet"))
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SENTENCES)], "doc_id long, text string")
    judged = lambda: {r["doc_id"]: (r["predicted"], r["score"]) for r in toxicity.score_toxicity(texts, model).collect()}
    got = judged()
    assert [got[k][0] for k in range(len(SENTENCES))] == [x for _, x in SENTENCES]
    assert got[4][1] < 0.5 < got[0][1]
    flat = {arc: (to, 1.0, 0.0, 1.0) for arc, (to, *_) in toxicity.compose(toxicity.compose(toxicity.TARGETED, toxicity.NEGATED), toxicity.REPORTED).items()}
    g = toxicity.Grammar(model["lexicon"])
    g.arcs = flat
    w = model["weights"]
    for k, (t, x) in enumerate(SENTENCES):
        neutral = w[0] + np.dot(w[1:], g.features(t))
        assert (neutral >= 0) == (k < 12)


def test_threats_and_insults_are_learned(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    def add(t, toxic):
        labels.append((len(rows), toxic))
        rows.append((len(rows), f"{' '.join(rng.choice(WORDS, 12))}. {t}. {' '.join(rng.choice(WORDS, 5))}"))
    for k in range(60):
        add("we shall smash you", 1)
        add("such a blorp", 1)
        add(f"please smash the {WORDS[k % 9]}", 0)
        add("you are kind", 0)
        add("kill the process and kill them both", 0)
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    g = toxicity.Grammar(model["lexicon"])
    assert g.symbol("smash")[0] == "threat" and g.symbol("blorp")[0] == "insult" and g.symbol("kill") is None and g.symbol("alpha") is None
    scored = toxicity.score_toxicity(spark.createDataFrame([(0, "they will smash you"), (1, "smash the pot"), (2, "no text"), (3, "what a blorp")], "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in sorted(scored)] == [1, 0, 0, 1]


# --- 10 ------------------------------------------------------------------------------------------------------------

def test_urls(spark, sf_dir):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/1", "http://example.org", "http://a.b.example.org/en/12?x=/es/", "https://xexample.org/es/", "http://x.com/de/#a", "http://com/fr/", "http://org", "a://b://c/d", "http://example.org./es/", "http://example.org/es/1"]
    table = spark.createDataFrame(list(enumerate(urls)) + [(12, urls[12])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")

    def judge(u):
        at = (u or "").find("://")
        rest = u[at + 3:] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]
    for df in (table, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        got = Counter(tuple(r) for r in url_rules.judge_urls(df, rules).collect())
        assert got == Counter((r["page_id"], *judge(r["url"])) for r in df.select("page_id", "url").collect())
    assert url_rules.judge_urls(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(table, rules.limit(0)).collect()} == {"allow"}


# --- pipeline ------------------------------------------------------------------------------------------------------

def brute_copies(rows):
    """How often the mix takes each (id, text, source) row: word by word budgets in the order of the keys."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for k, (i, t, source) in enumerate(rows):
        h = xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
        name = f"{{{'null' if i is None else i}, {h - 2**64 if h >= 2**63 else h}}}"
        by[source].append((int(hashlib.md5(f"mix-{name}-{size(t)}".encode()).hexdigest()[:15], 16), k, size(t)))
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: sum(x[2] for x in by[s]) for s in by}
    left, active, target = 1.5 * sum(total.values()), set(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        full = {s for s in active if 2 * total[s] <= level * weight[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else {s: level * weight[s] for s in active}
        left, active = left - sum(2 * total[s] for s in full), active - full if full else set()
    copies = {}
    for s, found in by.items():
        left = int(target[s])
        while left > 0 and total[s]:
            for _, k, n in sorted(found):
                if left > 0 and n:
                    copies[k] = copies.get(k, 0) + 1
                left -= n
    return copies


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = now
        before = given.select("doc_id", "text", "source", "lang").orderBy("doc_id").collect()
        now = corpus_pipeline.staged(stage(spark, given, sf_dir), name)
        assert now.columns == docs.columns
        after = Counter(r["doc_id"] for r in now.collect())
        if name == "language":
            want = brute_langid([(r["doc_id"], r["text"]) for r in before], [(r["text"], r["lang"]) for r in before if fold(r["doc_id"], 3) != 1])
            assert after == Counter(i for i, (lang, x) in want.items() if lang != "und" and x >= corpus_pipeline.LEAST_LANGUAGE)
        if name == "toxicity":
            model = queries.toxicity_model(given, labels)
            assert after == Counter(r["doc_id"] for r in before if brute_toxic(r["text"], model) < 0.5)
        if name == "near_dedup":
            root, exact, held = brute_near([r["text"] for r in before], corpus_pipeline.WORD_BITS, corpus_pipeline.SHINGLE_BITS, corpus_pipeline.DRAWS)
            assert after == Counter(before[k]["doc_id"] for k in set(root)) and held >= 0.9 * len(exact)
        if name == "mix":
            assert after == Counter({before[k]["doc_id"]: n for k, n in brute_copies([(r["doc_id"], r["text"], r["source"]) for r in before]).items()})
    final = corpus_pipeline.run(spark, sf_dir).collect()
    sp = pieces.PieceCoder(queries.tokenizer_path("piece_bpe_32k.model")).sp
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in final) == after
    for r in final:
        ids = sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


#: Columns of the operators and of the stages themselves.
CLASHES = ["score", "lang_pred", "predicted", "copies", "_id", "_hash", "_epoch", "key", "rest", "size", "taken", "fp", "node", "component_id", "_text", "target"]


@pytest.mark.parametrize("name", ["language", "toxicity", "near_dedup", "mix", "encode"])
def test_stages_take_odd_and_empty_tables(spark, odd, none, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    given = odd.select(*none.columns)
    assert stage(spark, given, sf_dir).count() <= 2 * len(ODD) and stage(spark, none, sf_dir).count() == 0
    plain = Counter(tuple(r) for r in stage(spark, given, sf_dir).collect())
    wide = stage(spark, given.select("*", *[F.lit(-7.5).alias(c) for c in CLASHES]), sf_dir)
    assert Counter(tuple(r)[:len(r) - (0 if name == "encode" else len(CLASHES))] for r in wide.collect()) == plain
    assert name == "encode" or (wide.columns == given.columns + CLASHES and {tuple(r[c] for c in CLASHES) for r in wide.collect()} == {(-7.5,) * len(CLASHES)})


# --- SQL -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: Counter(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows)
    assert key(got.select(*names).collect()) == key(want.fetchall())
