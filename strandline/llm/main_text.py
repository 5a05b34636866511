"""Main text of HTML pages: a tree-structured model over DOM nodes, whose content marginals come from sum-product messages up and down the tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Element names by their part in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select noframes audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark meta nobr picture q ruby rb rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
SCOPES = frozenset("button caption table td th body html #root".split())
#: A start tag ends open elements of these names, up to the nearest of the bounds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s<>/]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMES = re.compile(r"(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: States of a node: boilerplate, content, a wrapper of both.
STATES = {"b": 0, "c": 1, "w": 2}
#: Kinds of a child, each with a table of parent-child potentials of its own.
KINDS = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption caption".split()} | {t: 2 for t in "ul ol dl table tbody tr figure".split()} | {t: 3 for t in "div section article main body html".split()}
N_KINDS = 4


class Page:
    """The nodes of a page in document order (node 0 is the root) and its blocks of text, each with the node that holds it."""

    __slots__ = ("tags", "parents", "depths", "names", "marks", "own", "linked", "blocks")

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.names, self.marks = ["#root"], [-1], [0], [""], ["w" if source.lstrip()[:1] == "<" else "c"]
        self.own, self.linked, self.blocks = [0], [0], []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, parts, at, link, n = [0], [], 0, 0, len(source)
        opened: Counter[str] = Counter()

        def ended() -> None:
            """The block of text up to here is over: white space becomes one space."""
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text))
                    self.own[stack[-1]] += len(text)

        def add(chunk: str) -> None:
            if chunk:
                chunk = html.unescape(chunk) if "&" in chunk else chunk
                parts.append(chunk)
                if link:
                    self.linked[stack[-1]] += len(chunk)

        def pop(names: tuple[str, ...], bounds) -> None:
            """Close the nearest open element of these names, with all inside it, unless a bound lies between."""
            nonlocal link
            if not any(opened[t] for t in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[k]]
                if tag in names:
                    ended()
                    opened.subtract(self.tags[j] for j in stack[k:])
                    del stack[k:]
                    link = 0 if link > k else link
                    return
                if tag in bounds:
                    return

        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                add(source[at:])
                break
            if source.startswith("<!--", lt):
                add(source[at:lt])
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            m = TAG.match(source, lt)
            if not m:
                if source[lt + 1:lt + 2] in ("!", "?") or source[lt + 1:lt + 2] == "/" and not source[lt + 2:lt + 3].isspace():
                    add(source[at:lt])
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                elif source[lt + 1:lt + 2].isalpha() and source.find("<", lt + 1) < 0:  # the page ends within a tag
                    add(source[at:lt])
                    at = n
                else:
                    add(source[at:lt + 1])
                    at = lt + 1
                continue
            add(source[at:lt])
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "a":
                    link = 0
                elif tag == "br":
                    parts.append(" ")
                elif tag not in INLINE and tag not in ("body", "html"):
                    pop((tag,), ("td", "th", "table") if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else ("table",) if tag != "table" else ())
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
                parts.append(" ")
                continue
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in ("html", "body") and tag in [self.tags[k] for k in stack[:3]]:
                continue
            ended()
            if tag in CLOSES_P:
                pop(("p",), SCOPES)
            if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                opened[self.tags[stack.pop()]] -= 1
            if tag == "body":
                pop(("head",), SCOPES)
            if tag in ENDS:
                while True:
                    open_now = len(stack)
                    pop(ENDS[tag], BOUNDS.get(tag, ("table",)))
                    if len(stack) == open_now or tag in ("li", "dt", "dd", "option"):
                        break
            found = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(m[3])} if m[3] else {}
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.marks.append(found.pop("data-y", ""))
            self.names.append(" ".join(found.values()))
            self.own.append(0)
            self.linked.append(0)
            if tag not in VOID and not m[3].endswith("/"):
                stack.append(len(self.tags) - 1)
                opened[tag] += 1
        ended()


def _words(names: str) -> set[str]:
    return {w[:-1] if w.endswith("s") and len(w) > 3 else w for w in WORD.findall(CAMEL.sub(" ", names).lower())} if names else set()


#: Kinds of a feature and the bounds of the buckets of those that are numbers.
OWN, LINKS, PART = (1, 30, 120, 500), (0.0, 0.01, 0.3, 0.6), (0.05, 0.3, 0.7)


def features(page: Page) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """(names, buckets) of every node: its tag and the words of class, id and role; buckets of the length of its own text, the share of links in the text under it, and that text's share of the page."""
    n = len(page.tags)
    text, linked = list(page.own), [min(a, b) for a, b in zip(page.own, page.linked)]
    for k in range(n - 1, 0, -1):
        text[page.parents[k]] += text[k]
        linked[page.parents[k]] += linked[k]
    text, linked = np.array(text, np.float64), np.array(linked, np.float64)
    share = np.where(text > 0, linked / np.maximum(text, 1), -1.0)
    buckets = np.stack([np.searchsorted(b, v, "right") for b, v in ((OWN, page.own), (LINKS, share), (PART, text / max(1.0, text[0])))], axis=1)
    return [("any", f"tag {t}", *(f"name {w}" for w in _words(m))) for t, m in zip(page.tags, page.names)], buckets


def _bucket_names() -> list[list[str]]:
    return [[f"{name} {k}" for k in range(len(bounds) + 1)] for name, bounds in (("own", OWN), ("links", LINKS), ("part", PART))]


class Forest:
    """Pages as one forest of arrays: nodes with features, parents, kinds; messages run over all trees at once, a level at a time."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int]):
        sizes = np.array([len(p.tags) for p in pages], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.n = int(self.starts[-1])
        self.parent = np.concatenate([np.array(p.parents, np.int64) + np.where(np.array(p.parents) < 0, 0, s) for p, s in zip(pages, self.starts)]) if pages else np.zeros(0, np.int64)
        self.kind = np.array([KINDS.get(t, 0) for p in pages for t in p.tags], np.int64)
        found = [features(p) for p in pages]
        pairs = [(s + k, vocabulary[f]) for (names, _), s in zip(found, self.starts) for k, fs in enumerate(names) for f in fs if f in vocabulary]
        named = np.array(pairs, np.int64).reshape(-1, 2).T
        buckets = np.concatenate([b for _, b in found]) if found else np.zeros((0, 3), np.int64)
        numbers = [np.array([vocabulary.get(f, -1) for f in fs])[buckets[:, j]] for j, fs in enumerate(_bucket_names())]
        node, feature = np.concatenate([named[0], *[np.arange(self.n)] * 3]), np.concatenate([named[1], *numbers])
        self.node, self.feature = node[feature >= 0], feature[feature >= 0]
        depth = np.array([d for p in pages for d in p.depths], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))

    def scores(self, unary: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.node, weights=unary[self.feature, s], minlength=self.n) for s in range(unary.shape[1])], axis=1)

    def marginals(self, unary: np.ndarray, pairwise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node marginals, pair marginals of every node with its parent, log-partition of every tree) by messages up, then down."""
        inside = self.scores(unary)
        up = np.zeros((self.n, 3))
        table = pairwise[self.kind]
        for rows in self.levels[:0:-1]:
            up[rows] = _logsum(table[rows] + inside[rows][:, None, :], 2)
            np.add.at(inside, self.parent[rows], up[rows])
        total = _logsum(inside[self.levels[0]], 1) if self.n else np.zeros(0)
        belief, pair = inside.copy(), np.zeros((self.n, 3, 3))
        for rows in self.levels[1:]:
            above = belief[self.parent[rows]] - up[rows]
            joint = above[:, :, None] + table[rows] + inside[rows][:, None, :]
            belief[rows] = _logsum(joint, 1)
            pair[rows] = np.exp(joint - _logsum(joint.reshape(len(rows), 9), 1)[:, None, None])
        return np.exp(belief - _logsum(belief, 1)[:, None]), pair, total


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def learn(sources: list[str], least: int = 3, ridge: float = 0.02, rounds: int = 150, rate: float = 0.2) -> dict:
    """Potentials from labelled pages (data-y of an element: b, c or w), by gradient steps (Adam) on the likelihood of the labels.

    The gradient is what the labels show less what the marginals expect. Features that fewer than least nodes have are
    left out. sources is a bounded list; pages without elements teach by their root alone.
    """
    pages = [Page(s) for s in sources]
    seen = Counter()
    for names, buckets in map(features, pages):
        seen.update(f for fs in names for f in fs)
        seen.update(fs[k] for j, fs in enumerate(_bucket_names()) for k in buckets[:, j])
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    forest = Forest(pages, vocabulary)
    state = np.array([STATES.get(m, 0) for p in pages for m in p.marks], np.int64)
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    told, tied = np.zeros((len(vocabulary), 3)), np.zeros((N_KINDS, 3, 3))
    np.add.at(told, (forest.feature, state[forest.node]), 1.0)
    np.add.at(tied, (forest.kind[child], state[forest.parent[child]], state[child]), 1.0)
    theta = [np.zeros_like(told), np.zeros_like(tied)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, rounds + 1):
        single, pair, _ = forest.marginals(*theta)
        expected = np.zeros_like(told)
        for s in range(3):
            expected[:, s] = np.bincount(forest.feature, weights=single[forest.node, s], minlength=len(vocabulary))
        met = np.zeros_like(tied)
        np.add.at(met, forest.kind[child], pair[child])
        for j, (have, want) in enumerate(((expected, told), (met, tied))):
            gradient = (want - have) - ridge * theta[j]
            first[j] = 0.9 * first[j] + 0.1 * gradient
            second[j] = 0.99 * second[j] + 0.01 * gradient**2
            theta[j] += rate * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.99**k)) + 1e-6)
    return {"vocabulary": vocabulary, "unary": theta[0], "pairwise": theta[1]}


def main_texts(sources: list[str], model: dict) -> list[str]:
    """The blocks of every page whose node is content with a marginal of one half or more, joined by newlines."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages, model["vocabulary"])
    content = forest.marginals(model["unary"], model["pairwise"])[0][:, 1] >= 0.5
    return ["\n".join(text for k, text in p.blocks if content[s + k]) for p, s in zip(pages, forest.starts)]


def extract(pages: DataFrame, model: dict, html_col: str = "html", slice_chars: int = 1 << 20) -> DataFrame:
    """pages without html_col plus text (main text) and n_chars (its code points).

    A page becomes a tree of block elements with features; messages over the trees of about slice_chars characters (one page at least)
    at a time give every node its marginals. A block's text has character references decoded and
    white space turned into one space. No shuffle; memory follows a slice, or one page where that is longer.

    Null, empty and blank pages give an empty text; a page without elements is one block; long pages are read whole;
    repeated rows stay; an empty table gives none; columns text and n_chars of pages, if any, are replaced.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html"))
    out = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), "text string, n_chars long"])
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, waiting, held = [], [], 0
            for source in batch.column(len(rest)):
                waiting.append(source.as_py())
                held += len(waiting[-1])
                if held >= slice_chars:
                    texts += main_texts(waiting, model)
                    waiting, held = [], 0
            texts += main_texts(waiting, model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return rows.mapInArrow(run, out)
