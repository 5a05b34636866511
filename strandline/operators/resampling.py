"""Mergeable statistics of groups and their bootstrap intervals: no group or resample is whole in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ["metric", "grp"]
#: Distinct values of a bucket, and resamples whose states one call merges.
BUCKET, BLOCK = 16_384, 10


class Statistic:
    """A statistic made in parts. A state is a sequence of floats, of any length; values come with counts (at least 1)."""

    def start(self) -> tuple:
        raise NotImplementedError

    def update(self, state: tuple, values: np.ndarray, counts: np.ndarray) -> tuple:
        raise NotImplementedError

    def merge(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, state: tuple) -> float:
        raise NotImplementedError


class Mean(Statistic):
    def start(self):
        return 0.0, 0.0

    def update(self, state, values, counts):
        return state[0] + float(values @ counts), state[1] + float(counts.sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        return state[0] / state[1] if state[1] else float("nan")


class Extent(Statistic):
    """Largest less smallest value."""

    def start(self):
        return float("inf"), float("-inf")

    def update(self, state, values, counts):
        return (min(state[0], float(values.min())), max(state[1], float(values.max()))) if len(values) else state

    def merge(self, a, b):
        return min(a[0], b[0]), max(a[1], b[1])

    def finish(self, state):
        return state[1] - state[0]


class Whole(Statistic):
    """Any function of an array. Its state is all values and counts, so a group or resample does go whole to one task."""

    def __init__(self, fn: Callable[[np.ndarray], float]):
        self.fn = fn

    def start(self):
        return ()

    def update(self, state, values, counts):
        return (*state, *np.column_stack([values, counts]).ravel().tolist())

    def merge(self, a, b):
        return (*a, *b)

    def finish(self, state):
        v, n = np.array(state, float).reshape(-1, 2).T
        return float(self.fn(np.sort(np.repeat(v, n.astype(np.int64)))))


def mergeable(statistic: Statistic | Callable[[np.ndarray], float]) -> Statistic:
    return statistic if isinstance(statistic, Statistic) else Whole(statistic)


def _kinds(values: DataFrame) -> str:
    kinds = dict(values.dtypes)
    return f"metric {kinds['metric']}, grp {kinds['grp']}"


def group_statistic(values: DataFrame, statistic: Statistic | Callable[[np.ndarray], float], flush: int = 10_000) -> DataFrame:
    """(metric, grp, statistic) of values(metric, grp, value).

    Every task keeps one state a group over its Arrow batches (flush groups at most, then they are sent on), and only states are
    shuffled and merged. Null values are left out; a group without any has no row.
    """
    stat = mergeable(statistic)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def sent() -> pa.RecordBatch:
            keys = list(states)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], kinds[0]), pa.array([k[1] for k in keys], kinds[1]), pa.array([list(map(float, states[k])) for k in keys], pa.list_(pa.float64()))], ["metric", "grp", "state"])
            states.clear()
            return out

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in (0, 1)]
            m, g = (batch.column(k).dictionary_encode("encode") for k in (0, 1))
            names, groups, value = m.dictionary.to_pylist(), g.dictionary.to_pylist(), batch.column(2).to_numpy()
            code = m.indices.to_numpy().astype(np.int64) * max(1, len(groups)) + g.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
                key = names[code[at[0]] // len(groups)], groups[code[at[0]] % len(groups)]
                v, n = np.unique(value[at], return_counts=True)
                states[key] = stat.update(states.get(key, stat.start()), v, n)
                if len(states) >= flush:
                    yield sent()
        if states:
            yield sent()

    kinds = _kinds(values)
    parts = values.where("value is not null").select(*BY, F.col("value").cast("double").alias("value")).mapInArrow(part, f"{kinds}, state array<double>")
    parts = parts.withColumn("b", F.lit(0)).withColumn("salt", F.spark_partition_id() % 64)
    merged = _merged(_merged(parts, [*BY, "salt"], stat, kinds, False).withColumn("salt", F.lit(0)), [*BY, "salt"], stat, kinds, True)
    return merged.select(*BY, F.col("m").alias("statistic"))


def _merged(states: DataFrame, keys: list[str], stat: Statistic, kinds: str, finish: bool) -> DataFrame:
    """The states (metric, grp, b, state) of a key merged for each b; finished (m) or not (state)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for b, state in zip(group["b"], group["state"]):
            found[b] = stat.merge(found[b], tuple(state)) if b in found else tuple(state)
        last = {"m": [float(stat.finish(s)) for s in found.values()]} if finish else {"state": [list(map(float, s)) for s in found.values()]}
        return pd.DataFrame({c: [group[c].iat[0]] * len(found) for c in BY} | {"b": list(found)} | last)

    return states.groupBy(*keys).applyInPandas(run, f"{kinds}, b int, " + ("m double" if finish else "state array<double>"))


def _generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big"))


def split_draws(n: int, n_boot: int, bucket: int, path: list[tuple[int, int, int, int]], *seed) -> np.ndarray:
    """How many of the n draws of each resample fall into a bucket: down the tree from the root, each node splits its draws between its halves by a
    binomial drawn from the node's own seed, so that all buckets agree without meeting. path: (level, node, rows, rows of the left half), root first."""
    draws = np.full(n_boot, n, np.int64)
    for level, node, rows, left in path:
        first = _generator(*seed, level, node).binomial(draws, left / rows)
        draws = draws - first if bucket >> (level - 1) & 1 else first
    return draws


def draw_counts(draws: int, times: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How often each value is drawn, where times are its rows and total their running sum: picks of rows, or one multinomial where that is less work."""
    if draws <= 4 * len(times):
        return np.bincount(np.searchsorted(total, rng.integers(0, total[-1], draws), "right"), minlength=len(times))
    return rng.multinomial(draws, times / total[-1])


def _states(stat: Statistic, n_boot: int, seed: str):
    def run(key: tuple, rows: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        metric, grp, bucket = key
        rows = rows.sort_values("value")
        x, times, n = rows["value"].to_numpy(float), rows["t"].to_numpy(np.int64), int(paths["n"].iat[0])
        path = sorted(((int(p["level"]), int(p["node"]), int(p["rows"]), int(p["left"])) for p in paths["path"].iat[0]), reverse=True)
        total, rng, states = np.cumsum(times), _generator(seed, metric, grp, "rows", bucket), []
        for draws in split_draws(n, n_boot, bucket, path, seed, metric, grp):
            counts = draw_counts(int(draws), times, total, rng)
            met = np.flatnonzero(counts)
            states.append(list(map(float, stat.update(stat.start(), x[met], counts[met]))))
        return pd.DataFrame({"metric": metric, "grp": grp, "b": np.arange(n_boot, dtype=np.int32), "state": states})
    return run


def bootstrap_statistic(values: DataFrame, statistic: Statistic | Callable[[np.ndarray], float], n_boot: int = 1000, ci: float = 0.95, seed: str = "42", bucket: int = BUCKET) -> DataFrame:
    """(metric, grp, statistic, ci_low, ci_high, se): a statistic with percentile interval and population std over n_boot resamples of a group's size.

    Distinct values are counted, and dealt by hash to buckets of about `bucket` of them. The draws of a resample are split down a binary tree of a
    group's buckets (split_draws), and each bucket draws from its own rows, so a bucket is a task and only the states of (bucket, resample) are
    shuffled. Results do not depend on the layout of the table. Groups of one value have no interval: it is the statistic, with a std of 0.
    """
    stat, kinds = mergeable(statistic), _kinds(values)
    counts = values.where("value is not null").groupBy(*BY, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("t"))
    sizes = counts.groupBy(*BY).agg(F.sum("t").alias("n"), F.ceil(F.count("*") / bucket).cast("int").alias("k")).where("n >= 2")
    dealt = counts.join(sizes, BY).withColumn("bucket", F.pmod(F.xxhash64("value"), F.col("k")).cast("int"))
    leaves = dealt.groupBy(*BY, "n", "k", "bucket").agg(F.sum("t").alias("rows"))
    depth = F.ceil(F.log2(F.col("k").cast("double")) - 1e-9).cast("int")
    up = leaves.where("k > 1").withColumn("level", F.explode(F.sequence(F.lit(1), depth))).withColumn("node", F.expr("shiftright(bucket, level)"))
    left = F.when(F.expr("shiftright(bucket, level - 1)") % 2 == 0, F.col("rows")).otherwise(0)
    nodes = up.groupBy(*BY, "level", "node").agg(F.sum("rows").alias("_rows"), F.sum(left).alias("_left"))
    paths = up.join(nodes, [*BY, "level", "node"]).groupBy(*BY, "bucket").agg(F.collect_list(F.struct("level", "node", F.col("_rows").alias("rows"), F.col("_left").alias("left"))).alias("path"))
    paths = leaves.select(*BY, "bucket", "n").join(paths, [*BY, "bucket"], "left").toDF("metric_", "grp_", "bucket_", "n", "path").withColumn("path", F.coalesce("path", F.array().cast("array<struct<level:int,node:int,rows:bigint,left:bigint>>")))
    at = [*BY, "bucket"]
    states = dealt.groupBy(*at).cogroup(paths.groupBy(*[f"{c}_" for c in at])).applyInPandas(_states(stat, n_boot, seed), f"{kinds}, b int, state array<double>")
    drawn = _merged(states.withColumn("block", F.expr(f"b div {BLOCK}")), [*BY, "block"], stat, kinds, True)

    a = (1 - ci) / 2
    found = drawn.groupBy(*BY).agg(F.percentile("m", F.lit(a)).alias("ci_low"), F.percentile("m", F.lit(1 - a)).alias("ci_high"), F.stddev_pop("m").alias("se"))
    out = group_statistic(values, stat).join(found, BY, "left")
    return out.select(*BY, "statistic", *[F.coalesce(c, "statistic").alias(c) for c in ("ci_low", "ci_high")], F.coalesce("se", F.lit(0.0)).alias("se"))


def bootstrap_ci(values: DataFrame, n_boot: int = 1000, ci: float = 0.95, seed: str = "42", bucket: int = BUCKET) -> DataFrame:
    """(metric, grp, mean, ci_low, ci_high, se): the mean with the percentile interval and population std of its n_boot bootstrap means."""
    return bootstrap_statistic(values, Mean(), n_boot, ci, seed, bucket).withColumnRenamed("statistic", "mean")
