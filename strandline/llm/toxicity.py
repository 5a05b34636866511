"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon and a calibration learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandline.functions.staging import staged

# Small closed word classes of the grammar.
TARGETS = frozenset("you your yours you're he she him her they them this that these those people everyone du dein ihr euch tu toi vous votre usted ustedes tú".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't nicht kein keine jamais pas nunca".split())
REPORTS = frozenset("said says claimed called quoted reported wrote according sagte dit dijo".split())
# Seeds of the two learned classes; the labels may outweigh them and add to them.
THREATS = frozenset("kill hurt murder destroy strangle stab shoot slaughter umbringen töten tuer matar".split())
INSULTS = frozenset("idiot moron stupid imbecile scum loser trottel dummkopf crétin imbécile idiota estúpido".split())

#: Words, and marks that end a clause; a mark before a closing quotation mark, or a colon before an opening one, ends none, so that a speaker belongs to what is said.
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?](?![\"”»])|;|:(?!\s*[\"“„«])|\n")
ENDS = frozenset(".!?;:\n")
STEMS = range(4, 9)
#: Weights of the seeds, and the most that a learned word can weigh.
SEED_WEIGHT, MOST_WEIGHT = 3.0, 4.0

#: A transducer is {(state, symbol): (next state, factor now, factor held, scale)}: of a weight read, the first share counts at once
#: and the second when the clause still names a target; scale weakens what the clause has counted and holds so far. A symbol
#: without an arc leaves a state unchanged, with factors 1 and 0 and scale 1.
#: A target on either side in the clause makes an insult weigh half as much again, and a threat weigh at all.
TARGETED = {(0, "target"): (1, 1.0, 0.0, 1.0), (0, "insult"): (0, 1.0, 0.5, 1.0), (1, "insult"): (1, 1.5, 0.0, 1.0), (0, "threat"): (0, 0.0, 1.5, 1.0), (1, "threat"): (1, 1.5, 0.0, 1.0), (1, "end"): (0, 1.0, 0.0, 1.0)}
#: A negation takes nearly all weight from what follows within two words.
DENIED = 0.05
NEGATED = {(0, "negation"): (2, 1.0, 1.0, 1.0), (1, "negation"): (2, 1.0, 1.0, 1.0), (2, "word"): (1, 1.0, 1.0, 1.0), (1, "word"): (0, 1.0, 1.0, 1.0), (2, "target"): (1, 1.0, 1.0, 1.0), (1, "target"): (0, 1.0, 1.0, 1.0),
           (2, "insult"): (0, DENIED, DENIED, 1.0), (1, "insult"): (0, DENIED, DENIED, 1.0), (2, "threat"): (0, DENIED, DENIED, 1.0), (1, "threat"): (0, DENIED, DENIED, 1.0), (2, "end"): (0, 1.0, 1.0, 1.0), (1, "end"): (0, 1.0, 1.0, 1.0)}
#: Reported speech weakens its whole clause, before and after the verb.
TOLD = 0.1
REPORTED = {(0, "report"): (1, 1.0, 1.0, TOLD), (1, "insult"): (1, TOLD, TOLD, 1.0), (1, "threat"): (1, TOLD, TOLD, 1.0), (1, "end"): (0, 1.0, 1.0, 1.0)}


def compose(first: dict, second: dict) -> dict:
    """The product of two transducers; factors and scales multiply. The second one changes what the first counts and holds alike."""
    symbols = {s for _, s in first} | {s for _, s in second}
    states = lambda t: {q for q, _ in t} | {arc[0] for arc in t.values()}
    made = {}
    for p in states(first):
        for q in states(second):
            for s in symbols:
                (p2, now, held, scale), (q2, x, y, z) = first.get((p, s), (p, 1.0, 0.0, 1.0)), second.get((q, s), (q, 1.0, 1.0, 1.0))
                made[((p, q), s)] = ((p2, q2), now * x, held * y, scale * z)
    return made


class Grammar:
    """The composed transducers over word symbols. lexicon: words and stems ('abcd*') with (symbol, weight)."""

    CACHE = 300_000

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.arcs = compose(compose(TARGETED, NEGATED), REPORTED)
        self.seen: dict[str, tuple[str, float] | None] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """The symbol and weight of an insult or threat, else None; of the word and its beginnings the heaviest counts."""
        found = [x for x in (self.words.get(word), *(self.stems.get(word[:n]) for n in STEMS if len(word) >= n)) if x]
        return max(found, key=lambda x: x[1], default=None)

    def features(self, text: str) -> tuple[float, float, float]:
        """log(1 + sum of clause scores), the largest clause score, the sum for each 100 words of a text that is 50 words longer.

        All three follow the clauses' scores alone. Clauses without an insult or threat score nothing and leave the machine in its
        start state, so only the others are read.
        """
        if len(self.seen) > self.CACHE:
            self.seen.clear()
        tokens, seen = TOKEN.findall(text.lower()), self.seen
        for w in set(tokens).difference(seen):
            seen[w] = self.symbol(w)
        hits = [k for k, w in enumerate(tokens) if seen[w]]
        state, total, largest, done = ((0, 0), 0), 0.0, 0.0, -1
        for k in hits:
            if k <= done:
                continue
            lo = k
            while lo > 0 and tokens[lo - 1] not in ENDS:
                lo -= 1
            score, held, done = 0.0, 0.0, lo
            while done < len(tokens) and tokens[done] not in ENDS:
                w = tokens[done]
                kind, weight = seen[w] or ("target" if w in TARGETS else "negation" if w in NEGATIONS else "report" if w in REPORTS else "word", 0.0)
                state, now, later, scale = self.arcs.get((state, kind), (state, 1.0, 0.0, 1.0))
                score, held = score * scale + weight * now, held * scale + weight * later
                if state[0][0]:
                    score, held = score + held, 0.0
                done += 1
            state = self.arcs[state, "end"][0]
            total += score
            largest = max(largest, score)
        return math.log1p(total), largest, 100.0 * total / (len(tokens) + 50)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, toxic: int, clean: int) -> DataFrame:
    known = labels.where("toxic is not null").select(F.col(id_col), F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(id_col, F.lit("toxic")), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, int(1e6 * min(1.0, toxic / max(1, sizes.get(1, 0)))) + 1).otherwise(int(1e6 * min(1.0, clean / max(1, sizes.get(0, 0)))) + 1)
    return staged(docs.join(F.broadcast(known.where(draw < share)), id_col).select("toxic", "text"), "labelled")


def _odds(p: Column, n: Column, pos: int, neg: int) -> Column:
    return F.log((p + 0.5) / (pos + 1.0)) - F.log((n + 0.5) / (neg + 1.0))


def _longer(n: int):
    return lambda x: F.length(x) >= n


def _beginning(n: int):
    return lambda x: F.concat(F.substring(x, 1, n), F.lit("*"))


def _counts(sample: DataFrame, pos: int, neg: int) -> DataFrame:
    """Words and word beginnings (g) with the numbers of toxic (p) and clean (n) texts that hold them, the same for texts that hold
    them in a clause without a target (p0, n0), and the log-odds x, x0 of both."""
    clauses = sample.select("toxic", F.monotonically_increasing_id().alias("row"), F.explode(F.split(F.lower("text"), r"[.!?;:\n]")).alias("c"))
    words = clauses.select("toxic", "row", F.regexp_extract_all("c", F.lit(r"(\p{L}+(?:'\p{L}+)?)"), F.lit(1)).alias("w"))
    words = words.select("toxic", "row", F.array_distinct("w").alias("w"), F.arrays_overlap("w", F.array(*[F.lit(t) for t in sorted(TARGETS)])).alias("t"))
    begun = [F.transform(F.filter("w", _longer(n)), _beginning(n)) for n in STEMS]
    grams = words.select("toxic", "row", "t", F.explode(F.array_distinct(F.concat("w", *begun))).alias("g"))
    texts = grams.groupBy("row", "toxic", "g").agg(F.max((~F.col("t")).cast("int")).alias("free"))
    toxic, clean, free = F.col("toxic"), 1 - F.col("toxic"), F.col("free")
    found = texts.groupBy("g").agg(F.sum(toxic).alias("p"), F.sum(clean).alias("n"), F.sum(toxic * free).alias("p0"), F.sum(clean * free).alias("n0"))
    return found.withColumn("x", _odds(F.col("p"), F.col("n"), pos, neg)).withColumn("x0", _odds(F.col("p0"), F.col("n0"), pos, neg))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", toxic_rows: int = 3000, clean_rows: int = 6000, least_rows: int = 8, least_share: float = 0.02, least_odds: float = 3.0) -> dict:
    """Lexicon and calibration from labelled rows (id_col, toxic) joined to docs (id_col, text).

    The fit uses a sample of about toxic_rows toxic and clean_rows clean rows, chosen by the hash of the id (a bound in
    expectation, which also bounds the broadcast of the sampled ids); its texts are staged once. Words and word beginnings
    enter the lexicon with the log-odds of the documents that hold them when least_share of the toxic rows (least_rows at least)
    hold them and the log-odds reach least_odds. A word that tells a toxic text only beside a target is a threat: least_rows texts
    hold it in a clause without one, and by those alone its log-odds are below half of least_odds, while with a target in the clause they
    reach least_odds. All others are insults. Of nested beginnings the longest that still covers 95 % of the shorter
    one's rows stays. No word weighs more than MOST_WEIGHT. Seed words whose log-odds are not positive leave the lexicon. The
    calibration is a logistic regression of the label on the grammar's three features, all of clause scores, over the same sample.

    Null texts and labels teach nothing; empty texts count as texts without words; rows of equal ids and labels count as often as
    docs holds the id; without rows of both labels the seeds and a fixed calibration are the model. Other columns are ignored.
    """
    sample = _sample(docs.select(id_col, "text").where("text is not null"), labels, id_col, toxic_rows, clean_rows)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    seeds = dict.fromkeys(INSULTS, "insult") | dict.fromkeys(THREATS, "threat")
    lexicon = {w: (kind, SEED_WEIGHT) for w, kind in seeds.items()}
    if pos and neg:
        counts = _counts(sample, pos, neg).withColumn("x1", _odds(F.col("p") - F.col("p0"), F.col("n") - F.col("n0"), pos, neg))
        threat = (F.col("p0") + F.col("n0") >= least_rows) & (F.col("x0") < least_odds / 2) & (F.col("x1") >= least_odds)
        counts = counts.withColumn("threat", threat).withColumn("weight", F.when(F.col("threat"), F.col("x1")).otherwise(F.col("x")))
        rows = counts.where((F.col("p") >= max(least_rows, least_share * pos)) & (F.col("weight") >= least_odds) | F.col("g").isin(*seeds)).collect()
        told = {r["g"]: r for r in rows if r["weight"] >= least_odds and r["p"] >= max(least_rows, least_share * pos)}
        stems = {g[:-1]: r for g, r in told.items() if g.endswith("*")}
        kept: dict[str, tuple[str, float]] = {}
        kind = lambda r: "threat" if r["threat"] else "insult"
        for s in sorted(stems, key=lambda s: (len(s), s)):
            if any(s.startswith(k) for k in kept) or any(t != s and t.startswith(s) and stems[t]["p"] >= 0.95 * stems[s]["p"] for t in stems):
                continue
            kept[s] = (kind(stems[s]), min(stems[s]["weight"], MOST_WEIGHT))
        for r in rows:
            if r["g"] in seeds and r["weight"] <= 0:
                del lexicon[r["g"]]
            elif r["g"] in seeds:
                lexicon[r["g"]] = (seeds[r["g"]], min(max(r["weight"], SEED_WEIGHT), MOST_WEIGHT))
        lexicon |= {g: (kind(r), min(r["weight"], MOST_WEIGHT)) for g, r in told.items() if g not in seeds and not g.endswith("*") and not any(g.startswith(k) for k in kept)}
        lexicon |= {f"{s}*": x for s, x in kept.items()}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    weights = [-3.0, 1.0, 0.0, 0.5]
    if pos and neg:
        rows = np.array([tuple(r) for r in sample.mapInArrow(featured, "toxic int, a double, b double, c double").collect()], np.float64)
        weights = _logistic(rows[:, 1:], rows[:, 0])
    return {"lexicon": lexicon, "weights": weights}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
    return w.tolist()


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without text_col (unless keep_text) plus score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have no clause and get the score of a text without matches; whole texts are read; repeated
    rows stay; columns score and predicted of docs, if any, are replaced. No shuffle.
    """
    rows = docs.drop("score", "predicted")
    rows = rows.select(*[c for c in rows.columns if c != text_col], F.col(text_col).alias("_text"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"`{text_col}` string"] * keep_text
    out = ", ".join([*kept, "score double", "predicted int"])
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(model["lexicon"]), model["weights"]
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                a, b, c = grammar.features(text.as_py() or "")
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b + w[3] * c)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=schema)

    return rows.mapInArrow(run, out)
