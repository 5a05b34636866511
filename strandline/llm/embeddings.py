"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, spanning edges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.graph import connected_components
from strandline.functions.staging import staged
from strandline.llm.blocks import spanning_edges

KEYS = ["label", "dims", "cell"]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fit(cell_rows: int, fan: int, rounds: int, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(group["v"])
        k = min(len(x), fan, max(2, math.ceil(group["n"].iat[0] / cell_rows)))
        centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            at = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
        return pd.DataFrame({**{c: group[c].iat[0] for c in KEYS}, "sub": np.arange(k), "centre": list(centres)})
    return run


def _assign(threshold: float):
    sine = math.sqrt(1 - threshold * threshold)

    def run(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*KEYS, "node", "mult", "v", "home", "was")})
        base = rows[[*KEYS, "node", "mult", "v", "home", "was"]]
        if not len(cells):
            return base
        x = _unit(rows["v"])
        centres = np.stack(cells.sort_values("sub")["centre"].to_numpy())
        near = x @ centres.T
        own = near.argmax(axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(centres @ centres.T, -1, 1)))[own]
        far = near[np.arange(len(x)), own][:, None] - near
        home = rows["home"].to_numpy(bool)
        # A vector within the angle of x whose own cell is c lies across the bisector of both centres.
        # Of two vectors at home in this cell only the one of the earlier subcell visits; visitors of this cell visit all.
        visits = (far <= sine * gap + 1e-9) & np.where(home[:, None], np.arange(len(centres))[None, :] > own[:, None], True)
        r, c = np.nonzero(visits)
        at, sub = np.concatenate([np.flatnonzero(home), r]), np.concatenate([own[home], c])
        return base.iloc[at].assign(cell=rows["cell"].iat[0] + "." + pd.Series(sub.astype(str), base.index[at]), home=np.arange(len(at)) < home.sum())
    return run


def _compare(threshold: float, block: int = 1024):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["i"].iat[0], group["j"].iat[0]
        a, b = (group[group["chunk"] == c] for c in (low, high))
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = _unit(a["v"]), _unit(b["v"])
        ia, ib, ma, mb = a["node"].to_numpy(), b["node"].to_numpy(), a["mult"].to_numpy(), b["mult"].to_numpy()
        left, right, u, v = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [ia[:0]], [ia[:0]]
        for lo in range(0, len(a), block):
            near = x[lo:lo + block] @ y.T >= threshold
            if low == high:
                near[np.arange(len(near)), lo + np.arange(len(near))] = False
            left[lo:lo + block] = near @ mb
            right += ma[lo:lo + block] @ near
            r, c = np.nonzero(near)
            nodes, roots = spanning_edges(ia[lo + r], ib[c])
            u.append(nodes)
            v.append(roots)
        nodes, roots = spanning_edges(np.concatenate(u), np.concatenate(v))
        links = pd.Series(left, ia) if low == high else pd.concat([pd.Series(left, ia), pd.Series(right, ib)])
        links = links[links > 0]
        return pd.DataFrame({"node": links.index, "links": links.to_numpy()}).merge(pd.DataFrame({"node": nodes, "root": roots}), on="node")
    return run


def cells_of(classes: DataFrame, threshold: float, cell_rows: int, sample_rows: int, fan: int, rounds: int, seed: int) -> DataFrame:
    """classes (node, label, dims, v, mult) placed in cells: once at home, and as a visitor (home false) wherever an earlier vector must meet later ones.

    Every label of two classes or more gets spherical k-means centres, one for every cell_rows classes, two at least and fan at
    most. Cells with more than twice cell_rows at home are split in the same way, level by level, until they are small or
    keep nine tenths of what they split. Centres are fitted on about sample_rows vectors of a cell, chosen by hash.
    """
    kind = dict(classes.dtypes)["label"]
    todo = classes.select("label", "dims", F.lit("").alias("cell"), "node", "mult", "v", F.lit(True).alias("home"), F.lit(None).cast("long").alias("was"))
    fields, done, most = f"label {kind}, dims int, cell string, node long, mult long, v array<double>, home boolean, was long", None, 1
    while True:
        sizes = todo.groupBy(*KEYS).agg(F.count(F.when(F.col("home"), 1)).alias("n"), F.count("*").alias("m"), F.first("was").alias("parent"))
        sizes = sizes.where((F.col("n") > most) & F.coalesce(F.col("n") < 0.9 * F.col("parent"), F.lit(True))).drop("parent")
        if sizes.isEmpty():
            return todo if done is None else done.unionByName(todo)
        rows = todo.join(sizes, KEYS)
        drawn = rows.where(F.col("home") & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.greatest(F.lit(1e6 * sample_rows) / F.col("n"), F.lit(1))))
        centres = drawn.groupBy(*KEYS).applyInPandas(_fit(cell_rows, fan, rounds, seed), f"label {kind}, dims int, cell string, sub int, centre array<double>")
        salts = F.ceil(F.col("m") / F.lit(10_000)).cast("int")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), salts).cast("int")).withColumn("was", F.col("n"))
        spread = centres.join(sizes, KEYS).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        placed = salted.drop("n", "m").groupBy(*KEYS, "salt").cogroup(spread.drop("n", "m").groupBy(*KEYS, "salt")).applyInPandas(_assign(threshold), fields)
        rest = todo.join(sizes, KEYS, "left_anti").select(*todo.columns)
        done = rest if done is None else done.unionByName(rest)
        todo, most = staged(placed, "cells"), 2 * cell_rows


def near_vectors(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 2048, sample_rows: int = 5000, fan: int = 64, rounds: int = 8, seed: int = 5,
                 chunk_values: int = 1 << 18, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors, comparing rows of equal label and length.

    Equal vectors of a label are one class with a multiplicity and a number of its own, whatever their ids. Spherical
    k-means assigns classes to cells (cells_of). A class is at home in its nearest cell and visits each later cell
    whose bisector with its own lies within the threshold angle: any vector that close with its home there is met, so the
    result is exact whatever the cells. Home rows and visitors of a cell are cut by hash into chunks of chunk_values
    components (a cell of usual size is one chunk of home rows, so a visitor is sent once), and each pair of chunks is a blocked product of
    cosines in double precision, which leaves link counts and spanning edges, never the pairs. kept marks the row
    whose id is its component's smallest.

    Null, empty or zero vectors, vectors with null or non-finite components and rows with null labels link with
    nothing. Repeated rows and other rows of an equal id count as other vectors. Null ids are never a component's
    smallest unless it has no other. Empty tables give no rows; other columns are ignored.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("dims", F.size("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.col("dims") > 0) & fine, F.lit(False)))
    classes = rows.where("ok").groupBy("label", "dims", "v").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    placed = cells_of(classes, threshold, cell_rows, sample_rows, fan, rounds, seed)
    chunk = F.greatest(F.lit(16), F.floor(F.lit(chunk_values) / F.col("dims")))
    grid = placed.groupBy(*KEYS).agg(F.sum(F.col("home").cast("int")).alias("h"), F.sum((~F.col("home")).cast("int")).alias("p"))
    grid = grid.where("h > 0").select(*KEYS, F.ceil(F.col("h") / chunk).cast("int").alias("hs"), F.ceil(F.col("p") / chunk).cast("int").alias("ps"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    dealt = placed.join(grid, KEYS).withColumn("chunk", F.when(F.col("home"), part(F.col("hs"))).otherwise(F.col("hs") + part(F.col("ps"))))
    others = F.when(F.col("home"), F.sequence(F.lit(0), F.col("hs") + F.col("ps") - 1)).otherwise(F.sequence(F.lit(0), F.col("hs") - 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(*KEYS, "node", "mult", "v", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    found = staged(dealt.groupBy(*KEYS, "i", "j").applyInPandas(_compare(threshold), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "root"), "node", "root")
    known = staged(classes.join(links, "node", "left").join(parts, "node", "left").select(
        "label", "dims", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")), "classes")
    summary = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "dims", "v", "n_links", "component_id")
    good = rows.where("ok").join(summary, ["label", "dims", "v"]).select("id", "n_links", "component_id")
    every = good.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast(dict(summary.dtypes)["component_id"]).alias("component_id")))
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
