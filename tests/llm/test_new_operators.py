"""Main text, hard negatives and fill-in-middle: brute-force versions, handwritten pages, odd tables, SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import infill, layouts, main_text, negatives, queries


@pytest.fixture(scope="module")
def model():
    return main_text.learn(layouts.labelled_pages())


# --- 11 ------------------------------------------------------------------------------------------------------------

#: (page, its main text), laid out in ways that the labelled pages don't copy.
WRITTEN = [
    ("""<html><body class="home"><div id="header"><a href=/>My site</a></div><ul class="nav-menu"><li><a href=/a>One</a><li><a href=/b>Two</a></ul>
        <div class="post"><h1>A title</h1><p>First &amp; foremost,\n  a   <b>bold</b><i>er</i> word.<p>Second<br>line.<blockquote>Quoted &lt;text&gt;.</blockquote></div>
        <div id="comments"><p>Nice post, thank you very much for writing it all down for us.</p></div><div id="footer">&copy; 2020 My site</div></body></html>""",
     "A title\nFirst & foremost, a bolder word.\nSecond line.\nQuoted <text>."),
    ("""<!doctype html><title>T</title><header><nav><a href=1>Home</a> <a href=2>About</a></nav></header><main><article><header><h1>Head</h1></header><p>Short.</p>
        <aside class="related"><h3>Read on</h3><ul><li><a href=3>Other story</a></li></ul></aside><p>It goes on with <a href=4>a link</a> inside.</p><ul><li>item one</li><li>item two</li></ul>
        <form class="newsletter-signup"><label>Mail</label><input><button>Subscribe</button></form></article></main><aside><h3>Popular</h3><ul><li><a href=5>x</a></li></ul></aside><footer><p>Imprint</p></footer>""",
     "Head\nShort.\nIt goes on with a link inside.\nitem one\nitem two"),
    ("""<body><div class="cookie-banner"><p>We use cookies to make this site better. Accept?</p><button>OK</button></div><div class="page-wrapper"><div class="sidebar"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>
        <div class="entry-content"><h2>Heading</h2><script>var x = "<p>no</p>";</script><style>p{}</style><!-- <p>hidden</p> --><p>A para&shy;graph &#8212; with a dash.</p><div class="ad-slot">Buy this now!</div><p>The end.</p></div></div>
        <section class="comments-area"><div class="comment-body"><p>I disagree with every word of this article, and I will say so at length.</p></div></section></body>""",
     "Heading\nA para­graph — with a dash.\nThe end."),
]


@pytest.mark.parametrize("page,want", WRITTEN)
def test_written_pages(model, page, want):
    assert main_text.main_texts([page], model) == [want]


def test_held_out_layouts(model):
    """Pages drawn from other seeds: all the content and nothing else on 97 of 100."""
    pages = [layouts._Layout(5_000_000 + k).page() for k in range(300)]
    read = [main_text.Page(p) for p in pages]
    want = ["\n".join(t for k, t in p.blocks if p.marks[k] == "c") for p in read]
    got = main_text.main_texts([re.sub(r' ?data-y="?[bcw]"?', "", p) for p in pages], model)
    assert sum(a == b for a, b in zip(got, want)) >= 291


def test_messages_equal_enumeration():
    """Marginals of nodes and pairs, and the partition sum, against all labellings of small trees."""
    rng = random.Random(3)
    for n in (1, 2, 4, 6):
        page = main_text.Page("x")
        page.tags, page.parents, page.names, page.own, page.linked = ["p"] * n, [-1] + [rng.randrange(k) for k in range(1, n)], [""] * n, [0] * n, [0] * n
        page.depths = [0] * n
        for k in range(1, n):
            page.depths[k] = page.depths[page.parents[k]] + 1
        page.tags = [rng.choice(["p", "div", "ul", "nav"]) for _ in range(n)]
        vocabulary = {f"tag {t}": k for k, t in enumerate(("p", "div", "ul", "nav"))}
        unary, tables = np.random.default_rng(n).normal(size=(4, 3)), np.random.default_rng(n + 1).normal(size=(4, 3, 3))
        single, pair, total = main_text.Forest([page], vocabulary).marginals(unary, tables)
        weights, nodes, pairs = 0.0, np.zeros((n, 3)), np.zeros((n, 3, 3))
        for code in range(3**n):
            y = [code // 3**k % 3 for k in range(n)]
            w = np.exp(sum(unary[vocabulary[f"tag {page.tags[k]}"], y[k]] for k in range(n)) + sum(tables[main_text.KINDS.get(page.tags[k], 0), y[page.parents[k]], y[k]] for k in range(1, n)))
            weights += w
            for k in range(n):
                nodes[k, y[k]] += w
                if k:
                    pairs[k, y[page.parents[k]], y[k]] += w
        assert np.allclose(single, nodes / weights) and np.allclose(pair, pairs / weights) and np.allclose(total, np.log(weights))


def test_labels_teach_the_model():
    """With the labels turned round, what was content is boilerplate."""
    swap = {"b": "c", "c": "b", "w": "w"}
    turned = [re.sub(r'data-y="?([bcw])"?', lambda m: f'data-y="{swap[m[1]]}"', p) for p in layouts.labelled_pages(150)]
    assert "A title" not in main_text.main_texts([WRITTEN[0][0]], main_text.learn(turned))[0]


ODD_MARKUP = [
    ("<", ["<"]), ("a < b", ["a < b"]), ("x<p", ["x"]), ("a<b<p>c", ["a<b", "c"]), ("<p title='a>b'>x", ["x"]), ("<p =\"'>y</p>", ["y"]), ("x<!--", ["x"]), ("x<!-- y --z", ["x"]), ("x<script>never closed", ["x"]),
    ("a<script>1</script>b", ["a b"]), ("&bogus;&amp&lt;p&gt;&#65;", ["&bogus;&<p>A"]), ("<li>a<li>b<td>c</p></div></nope>z", ["a", "b", "cz"]), ("<table><tr><td>a<tr><td>b<table><td>c</table>d</table>e", ["a", "b", "c", "d", "e"]),
    ("a\u00a0\u3000 b\t\nc", ["a b c"]), ("<h1>a<h2>b", ["a", "b"]), ("<p><b>a<br><p>b</b>c", ["a", "bc"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]), ("<a href=1><div>a</div></a>b", ["a", "b"]), ("<?xml x?><!DOCTYPE y>z</ >w", ["z</ >w"]),
]


@pytest.mark.parametrize("source,want", ODD_MARKUP)
def test_odd_markup_is_read(source, want):
    page = main_text.Page(source)
    assert [t for _, t in page.blocks] == want
    assert len(page.tags) == len(page.parents) == len(page.depths) == len(page.own) and all(p < k for k, p in enumerate(page.parents))


def test_hostile_pages_take_linear_time():
    import time
    for piece in ("<a", "<div>", "<p \"='", "<!-", "</x", "<x y=\"", "<li>", "<td>", "<script>", "<a href='"):
        began = time.time()
        main_text.Page(piece * 20_000)
        assert time.time() - began < 15, piece


def test_extract_odd_tables(spark, model):
    rows = [(1, "u", None, "x", 5), (None, None, "", None, 5), (3, "u", "  \n ", "x", 5), (4, None, "just text", "x", 5), (4, None, "just text", "x", 5), (5, "u", "<article><p>" + "long text here. " * 40_000 + "</article>", "x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:30], r["n_chars"]) for r in main_text.extract(df, model).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (0, None, "", 0), (3, "u", "", 0), (4, None, "just text", 9), (4, None, "just text", 9), (5, "u", "long text here. long text here", 16 * 40_000 - 1)], key=str)
    assert main_text.extract(df.limit(0), model).count() == 0


# --- 12 ------------------------------------------------------------------------------------------------------------

def brute_negatives(rows):
    """Every anchor against every row, straight from the definition."""
    fit = []
    for rid, (i, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        fit.append((i, label, [int(np.floor(256 * float(x))) for x in v], rid))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for i, label, v, rid in fit:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, r, lab) for j, lab, w, r in fit if r != rid and len(w) == len(v)]
        for p in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            fits = sorted((s for s in scored if s[3] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:3]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, aid string, score int")
    got = negatives.hard_negatives(negatives.relabelled(df), F.col("vec_id") % 50 == 0, **sizes)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_negatives_match_brute_force(spark):
    rng = np.random.default_rng(4)
    f32 = lambda x: [float(np.float32(y)) for y in x]
    base = rng.normal(size=(6, 8))
    rows = [(int(i), f32(base[rng.integers(6)] + 0.3 * rng.normal(size=8)), int(rng.integers(4))) for i in range(1, 700)]
    rows += [(int(i), f32(np.round(rng.normal(size=8))), int(rng.integers(3))) for i in range(700, 900)]  # ties
    same = f32(base[0])
    rows += [(int(i), same, 2) for i in range(900, 1200)] + [(1000, same, 3), (1000, same, 3), (1050, f32(base[1]), 1), (1050, f32(base[2]), 1)]
    rows += [(None, f32(base[0]), 1), (None, same, 2), (50, None, 1), (100, [], 1), (150, [1.0, None] + [0.0] * 6, 1), (200, [float("nan")] * 8, 1), (250, [float("inf")] * 8, 1), (300, same, None), (350, [0.0] * 8, 1), (400, [1.0, 2.0], 1), (401, [2.0, 1.0], 1), (402, [1.0, 1.5], 2)]
    want = brute_negatives(rows)
    assert len(want) > 200
    assert mined(spark, rows, group_rows=7, chunk_values=400) == want
    assert mined(spark, rows) == want
    assert mined(spark, rows[:0]) == []


def test_long_scores_are_exact(spark):
    rows = [(50 * k, [float(2**17 + 3 * k), float(2**16 - k), 1.5], k % 2) for k in range(12)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_tree_is_a_spanning_tree_of_least_length():
    x = np.random.default_rng(1).integers(-5, 6, size=(40, 3)).astype(float)
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(0 <= parent[k] < k for k in range(1, 40))
    assert np.allclose(edge[1:], [np.linalg.norm(x[order[k]] - x[order[parent[k]]]) for k in range(1, 40)])
    joined, pairs = list(range(40)), sorted((np.linalg.norm(x[a] - x[b]), a, b) for a in range(40) for b in range(a))
    total = 0.0
    for d, a, b in pairs:
        if joined[a] != joined[b]:
            total += d
            joined = [joined[a] if j == joined[b] else j for j in joined]
    assert np.isclose(edge.sum(), total)


def test_bounds_hold_and_spare_scores():
    """Near anchors: every candidate stays within its bounds, and most are not scored again."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    x = np.round(100 * (rng.normal(size=16) + 0.01 * rng.normal(size=(20, 16))))
    c = np.round(100 * rng.normal(size=(500, 16)))
    order, parent, edge = negatives.spanning_tree(x)
    table = lambda v, **more: pa.table({"v": pa.array(v.astype(int).tolist(), pa.list_(pa.int32())), **more})
    looked = []

    def choose(k, low, high):
        exact = c @ x[order][k]
        assert (low <= exact).all() and (exact <= high).all()
        rows = high >= negatives._kth(low, 6)
        looked.append(rows.sum())
        return rows
    negatives._bounded(table(x[order], parent=parent, edge=edge), table(c), 16, choose)
    assert np.mean(looked[1:]) < 100


# --- 13 ------------------------------------------------------------------------------------------------------------

def brute_infill(i, t):
    s = t or ""
    n, digest = len(s), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not s or any(m in s for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, s
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s[b:]}<P>{s[:a]}<M>{s[a:b]}"
    return n, "psm", a, b - a, f"<P>{s[:a]}<S>{s[b:]}<M>{s[a:b]}"


@pytest.mark.parametrize("slice_bytes", [1, 50, 4 << 20])
def test_infill_matches_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(infill, "SLICE_BYTES", slice_bytes)
    rng = random.Random(7)
    odd = ["", None, "a", "é", "🙂", "<P>", "x<S>y", "<M", "<", "<P", "S>", "<<<>>>", "\u0000", " \n", "é", "日本語のテキスト" * 30, "long " * 30_000]
    texts = odd + ["".join(rng.choice("ab<>PSM é🙂ß\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)] + [(5, "same", "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = infill.fill_in_middle(df).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(((i, *brute_infill(i, t)) for i, t, *_ in rows), key=key)
    assert sorted(r["again"] for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_new_queries_are_registered():
    assert {"op11_main_text", "op12_negatives", "op13_infill"} <= set(queries.QUERIES) & set(queries.ORACLE_SQL)
