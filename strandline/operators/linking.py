"""Linking detections(recording_id, frame, label, cy, cx, area_px) into tracks."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.functions.graph import connected_components
from strandline.functions.primitives import fill_linear, running_sum
from strandline.functions.staging import staged
from strandline.operators.matching import cheapest, dealt, members, pairs_within, places
from strandline.operators.tracks import KEYS, valid

DET = ["recording_id", "frame", "label"]
MAX_GAP = 11
#: Squares are wider than the reach by this, so that rounding at their edges parts no pair at exactly the reach.
WIDER = 1 + 1e-9
#: Distances that differ by less than this share may fall in another order when their squares are rounded otherwise.
NEARLY = 1e-14


def distance(y: str, x: str, y2: str, x2: str) -> Column:
    """Distance of two points. Squares are products: pow is not rounded correctly, so that distances that are equal would differ."""
    dy, dx = F.col(y) - F.col(y2), F.col(x) - F.col(x2)
    return F.sqrt(dy * dy + dx * dx)


def squared(df: DataFrame, y: str, x: str, reach: Column) -> DataFrame:
    """df with gy, gx: the square of twice the reach that holds the point."""
    return df.withColumn("gy", F.floor(F.col(y) / (2 * reach)).cast("long")).withColumn("gx", F.floor(F.col(x) / (2 * reach)).cast("long"))


def touching(df: DataFrame, y: str, x: str, reach: Column) -> DataFrame:
    """df with one row for every square gy, gx of squared that holds a point within reach: four at most."""
    at = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + s * reach) / (2 * reach)).cast("long") for s in (-1, 1)])))
    return df.withColumn("gy", at(y)).withColumn("gx", at(x))


def link_candidates(det: DataFrame, hop: float = 20.0, max_gap: int = MAX_GAP) -> DataFrame:
    """Pairs of detections 1 to max_gap frames apart within hop * gap.

    A range join as an equi-join over places (detections of a frame at one place are one row with their labels): the plane is cut into
    squares of twice the longest reach and the frames into blocks of max_gap. The later place lies in one of each; the earlier one is sent to
    the squares its reach touches (four at most) and the two blocks in which partners may be, so what is shuffled and sorted
    does not grow with the number of gaps or pairs. Pairs are made by the join and leave it at once. Sizes are estimated from the
    table before its rows are multiplied, so the join is told not to broadcast them.
    """
    at = det.groupBy("recording_id", "frame", "cy", "cx").agg(F.collect_list("label").alias("_labels"))
    side = F.lit(float(hop) * max_gap * WIDER)
    block = lambda n: F.floor((F.col("frame") + n) / max_gap)
    a = touching(at, "cy", "cx", side).withColumn("_block", F.explode(F.array_distinct(F.array(block(1), block(max_gap)))))
    b = squared(at, "cy", "cx", side).withColumn("_block", block(0)).withColumnsRenamed({"frame": "frame2", "cy": "cy2", "cx": "cx2", "_labels": "_labels2"})
    met = a.join(b.hint("merge"), ["recording_id", "_block", "gy", "gx"]).withColumn("gap", F.col("frame2") - F.col("frame")).withColumn("dist", distance("cy", "cx", "cy2", "cx2"))
    met = met.where(F.col("gap").between(1, max_gap) & (F.col("dist") <= F.col("gap") * F.lit(float(hop))))
    met = met.select("recording_id", "frame", F.explode("_labels").alias("label"), "frame2", "_labels2", "gap", "dist")
    return met.select(*DET, "frame2", F.explode("_labels2").alias("label2"), "gap", "dist")


def positions(det: DataFrame, keys: list[str]) -> DataFrame:
    """One row for every place of a frame: of detections at the same one only that of the lowest label can be the nearest to anything."""
    return det.groupBy(*keys, "cy", "cx").agg(F.min("label").alias("label"))


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], hop: float, ties: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, label, label2, dist): of every query (keys, label, cy, cx) the nearest point (keys, label, cy, cx) within hop, lowest label among equals.

    With ties, names of columns of points: (keys, label, near), where near holds all points nearly as near as the nearest, as (dist, dy, dx, label2, cy, cx, those columns).
    Points are gathered as arrays by square of reach, each with those around it, so that a query meets one array and no pairs are shuffled or sorted. The first
    reach is small enough for squares of a few points; queries that found none there look four times as far, up to hop.
    """
    crowd = squared(points, "cy", "cx", F.lit(float(hop))).groupBy(*keys, "gy", "gx").count().agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("c")).first()["c"] or 1
    reach = hop / 4 ** max(0, math.ceil(math.log(crowd / 2, 16)))
    d = lambda p: F.sqrt((F.col("cy") - p["cy"]) * (F.col("cy") - p["cy"]) + (F.col("cx") - p["cx"]) * (F.col("cx") - p["cx"]))
    open_, found = queries.select(*keys, "label", "cy", "cx"), []
    while True:
        side = F.lit(float(reach) * WIDER)
        around = touching(points, "cy", "cx", side).groupBy(*keys, "gy", "gx").agg(F.collect_list(F.struct("cy", "cx", "label", *(ties or ()))).alias("_near"))
        met = squared(open_, "cy", "cx", side).join(around.hint("merge"), [*keys, "gy", "gx"], "left")
        if ties is None:
            best = F.array_min(F.transform("_near", lambda p: F.struct(d(p).alias("dist"), p["label"].alias("label2"))))
            out = ["label2", "dist"]
            seen = met.select(*keys, "label", "cy", "cx", best.alias("_m")).select(*keys, "label", "cy", "cx", "_m.label2", "_m.dist")
        else:
            all_ = F.transform("_near", lambda p: F.struct(d(p).alias("dist"), (F.col("cy") - p["cy"]).alias("dy"), (F.col("cx") - p["cx"]).alias("dx"), p["label"].alias("label2"), *[p[c].alias(c) for c in ("cy", "cx", *ties)]))
            least = met.select(*keys, "label", "cy", "cx", all_.alias("_all")).withColumn("dist", F.array_min("_all")["dist"])
            out = ["near"]
            seen = least.select(*keys, "label", "cy", "cx", "dist", F.filter("_all", lambda p: p["dist"] <= F.col("dist") * (1 + NEARLY)).alias("near"))
        seen = staged(seen, "nearest")
        near = F.coalesce(F.col("dist") <= F.lit(float(reach)), F.lit(False))
        found.append(seen.where(near).select(*keys, "label", *out))
        open_, reach = seen.where(~near).select(*keys, "label", "cy", "cx"), 4 * reach
        if reach > hop or open_.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def link_mutual_nearest(det: DataFrame, hop: float = 20.0) -> DataFrame:
    """Frame-to-frame links in which each detection is the other's nearest (lowest label among equals)."""
    keys = ["recording_id", "frame"]
    at = staged(positions(det, keys), "positions")
    out = nearest(at, at.withColumn("frame", F.col("frame") - 1), keys, hop)
    back = nearest(at.withColumn("frame", F.col("frame") - 1), at, keys, hop).select(*keys, F.col("label2").alias("label"), F.col("label").alias("label2"))
    return out.join(back, [*keys, "label", "label2"]).select(*DET, (F.col("frame") + 1).alias("frame2"), "label2", "dist")


def numbered_tracks(rooted: DataFrame) -> DataFrame:
    """rooted(recording_id, root_frame, root_label, ...) with track_id: the number of its root among the recording's roots in order of frame and label.

    Only the roots are numbered, one row a track, by distributed running sums; no task orders the detections of a recording.
    """
    roots = rooted.select("recording_id", "root_frame", "root_label").distinct()
    roots = roots.withColumn("_at", F.col("root_frame").cast("long") * F.lit(1 << 32) + F.col("root_label")).withColumn("_one", F.lit(1))
    ids = running_sum(roots, ["recording_id"], "_at", "_one", "_id").select("recording_id", "root_frame", "root_label", F.col("_id").cast("int").alias("track_id"))
    return rooted.join(ids, ["recording_id", "root_frame", "root_label"])


def tracks_from_links(det: DataFrame, links: DataFrame) -> DataFrame:
    """Detections with track_id: components of the link graph, numbered within a recording by their first detection."""
    a, b = F.struct("recording_id", "frame", "label"), F.struct("recording_id", F.col("frame2").alias("frame"), F.col("label2").alias("label"))
    parts = connected_components(links.select(a.alias("a"), b.alias("b")))
    d = det.withColumn("node", a).join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    d = d.withColumn("root_frame", F.col("root.frame")).withColumn("root_label", F.col("root.label"))
    return numbered_tracks(d).select("recording_id", "track_id", "frame", "label", "cy", "cx", "area_px")


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = slack < best[free]
            best[free[better]], back[free[better]] = slack[better], j0
            j1 = free[np.argmin(best[free])]
            delta = best[j1]
            u[owner[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def match(near: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """As many allowed pairs as possible, then the smallest total distance: forbidden cells cost more than all distances."""
    if not near.size or not allowed.any():
        return []
    big = 1.0 + near[allowed].sum()
    cost = np.where(allowed, near, big)
    wide = cost.shape[0] <= cost.shape[1]
    cols = assign(cost if wide else cost.T)
    pairs = [(i, j) if wide else (j, i) for i, j in enumerate(cols)]
    return [(i, j) for i, j in pairs if allowed[i, j]]


def match_sparse(edges: list[tuple[int, int, float]], place: np.ndarray | None = None, age: np.ndarray | None = None) -> list[tuple[int, int]]:
    """match over allowed pairs (track, point, distance) alone.

    Where place numbers all tracks and points, those at one place are taken together, and of its tracks the oldest (by age) goes first.
    """
    if len(edges) == 1:
        return [edges[0][:2]]
    tracks, points = sorted({t for t, _, _ in edges}, key=None if age is None else age.__getitem__), sorted({p for _, p, _ in edges})
    at = [np.unique(ids if place is None else place[ids], return_inverse=True)[1] for ids in (tracks, points)]
    there, here = [members(n, n.max(initial=-1) + 1) for n in at]
    i, j = [dict(zip(ids, n.tolist())) for ids, n in zip((tracks, points), at)]
    near = {(i[t], j[p]): d for t, p, d in edges}
    ends = np.array(list(near), int).reshape(-1, 2)
    flows = cheapest(ends[:, 0], ends[:, 1], np.array(list(near.values()), float), [len(m) for m in there], [len(m) for m in here])
    return [(tracks[t], points[p]) for t, p in dealt(flows, there, here)]


def step_tracks(live: dict, frame: int, points: np.ndarray, hop: float, max_gap: int, spawn: bool, next_id: int) -> tuple[list[int], int]:
    """Advance live {track: (y, x, last frame)} by one frame's points; the track of every point (-1: none) and the next free id.

    Tracks that were last seen in the same frame at the same place are one place with room for all of them, and so are points.
    """
    for t in [t for t, (_, _, last) in live.items() if frame - last > max_gap]:
        del live[t]
    ids, owner = sorted(live), [-1] * len(points)
    if ids and len(points):
        at = np.array([live[t] for t in ids])
        there, first = places(at[:, 2], at[:, 0], at[:, 1])
        here, first2 = places(points[:, 0], points[:, 1])
        y, x, last = at[first].T
        y2, x2 = points[first2].T
        near = [np.concatenate(c) for c in zip(*pairs_within(y, x, hop * (frame - last), y2, x2))]
        tracks, found = members(there, len(first)), members(here, len(first2))
        if near:
            for i, j in dealt(cheapest(*near, [len(m) for m in tracks], [len(m) for m in found]), tracks, found):
                owner[j] = ids[i]
    for j, (y, x) in enumerate(points.tolist()):
        if owner[j] < 0 and spawn:
            owner[j], next_id = next_id, next_id + 1
        if owner[j] >= 0:
            live[owner[j]] = (y, x, frame)
    return owner, next_id


def may_meet(det: DataFrame, hop: float, max_gap: int) -> DataFrame:
    """det with part: no chain of link candidates connects the detections of two parts.

    A box is what lies in a square of half the longest reach and a block of max_gap frames. Boxes that could hold the ends of a candidate are linked,
    and parts are their connected components: one row a box and 50 links at most, however crowded it is. Parts are a little coarser than
    the components of candidates, as a box is not split. Places that are no numbers meet nothing and stay in their box.
    """
    half, box = hop * max_gap / 2, ["recording_id", "block", "gy", "gx"]
    at = squared(det, "cy", "cx", F.lit(half / 2 * WIDER)).withColumn("block", F.floor(F.col("frame") / max_gap))
    ends = [f(c).alias(f"{n}_{c}") for c in ("frame", "cy", "cx") for n, f in (("low", F.min), ("high", F.max))]
    boxes = staged(at.where((F.abs("cy") < math.inf) & (F.abs("cx") < math.inf)).groupBy(*box).agg(*ends), "boxes")
    near = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2))
    sent = boxes.withColumn("block2", F.explode(F.array("block", F.col("block") + 1))).withColumn("gy2", near("gy")).withColumn("gx2", near("gx"))
    met = sent.join(boxes.withColumnsRenamed({c: f"{c}2" for c in boxes.columns[1:]}).hint("merge"), ["recording_id", "block2", "gy2", "gx2"])
    apart = lambda c: F.greatest(F.col(f"low_{c}2") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"high_{c}2"), F.lit(0.0))
    gap = F.least(F.col("high_frame2") - F.col("low_frame"), F.lit(max_gap))
    met = met.where((gap >= 1) & (F.col("low_frame2") - F.col("high_frame") <= max_gap) & (F.sqrt(apart("cy") * apart("cy") + apart("cx") * apart("cx")) <= gap * hop * WIDER))
    node = lambda n: F.struct("recording_id", *[F.col(f"{c}{n}").alias(c) for c in box[1:]])
    parts = connected_components(met.select(node("").alias("a"), node("2").alias("b")))
    return at.withColumn("node", node("")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).select(*det.columns, "part")


def _follow(hop: float, max_gap: int, spawn: bool):
    """Roots of the detections of one part, frame by frame."""

    def run(key: tuple, det: pd.DataFrame) -> pd.DataFrame:
        det = det.sort_values(["frame", "label"], kind="stable", ignore_index=True)
        live, free, root, roots = {}, 0, np.full(len(det), -1), []
        at, first = det[["cy", "cx"]].to_numpy(float), det["first"].to_numpy()
        for frame, rows in det.groupby("frame", sort=True).indices.items():
            owner, free = step_tracks(live, int(frame), at[rows], hop, max_gap, spawn or bool(first[rows[0]]), free)
            for j, t in zip(rows.tolist(), owner):
                if t == len(roots):
                    roots.append(j)
                if t >= 0:
                    root[j] = roots[t]
        det["root_frame"], det["root_label"] = det["frame"].to_numpy()[root], det["label"].to_numpy()[root]
        return det.loc[root >= 0, ["recording_id", "root_frame", "root_label", "frame", "label", "cy", "cx", "area_px"]]
    return run


def track_assign(det: DataFrame, hop: float = 20.0, max_gap: int = MAX_GAP, spawn: bool = True, min_length: int = 1) -> DataFrame:
    """Exact one-to-one assignment frame by frame: as many links as possible, then the least total distance.

    A track may miss max_gap - 1 frames; its hop grows with the gap. Unmatched detections start tracks (only those of the recording's
    first occupied frame without spawn). Parts of a recording that no candidates connect (may_meet) are followed each by itself, in one task that
    makes the pairs of one frame at a time (step_tracks); no table of candidates is made. Track ids number the roots of a recording.
    """
    first = det.groupBy("recording_id").agg(F.min("frame").alias("_first"))
    rows = may_meet(staged(det.withColumns({c: F.col(c).cast("double") for c in ("cy", "cx")}), "detections"), float(hop), max_gap).join(first, "recording_id")
    rows = rows.select("recording_id", "part", "frame", "label", "cy", "cx", "area_px", (F.col("frame") == F.col("_first")).alias("first"))
    kinds = dict(det.dtypes)
    fields = f"recording_id {kinds['recording_id']}, root_frame int, root_label int, frame int, label int, cy double, cx double, area_px {kinds['area_px']}"
    tracks = numbered_tracks(staged(rows.groupBy("part").applyInPandas(_follow(float(hop), max_gap, spawn), fields), "rooted"))
    if min_length > 1:
        long = tracks.groupBy(*KEYS).agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= min_length)
        tracks = tracks.join(long.select(*KEYS), KEYS, "left_semi")
    return tracks.select("recording_id", "track_id", *DET[1:], "cy", "cx", "area_px")


def nearest_later(at: DataFrame, hop: float) -> DataFrame:
    """(recording_id, n, label, next_n, next_label): of every place the nearest one within hop (lowest label among equals) in the first later frame that has any.

    at (positions) carries n, the number of its frame among the recording's occupied ones. Most find a follower in the next frame; the others are
    sent to the squares that hop touches and to blocks of frames that are four times as long from round to round, so that rounds grow with
    the logarithm of the frames and only places without one nearby look far ahead.
    """
    here = ["recording_id", "n", "label"]
    soon = nearest(at, at.withColumn("n", F.col("n") - 1), ["recording_id", "n"], hop)
    found = [soon.select(*here, (F.col("n") + 1).alias("next_n"), F.col("label2").alias("next_label"))]
    open_ = staged(at.join(soon.select(*here).hint("merge"), here, "left_anti").select(*here, "cy", "cx"), "followers")
    b = squared(at.select("recording_id", F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("cy").alias("cy2"), F.col("cx").alias("cx2")), "cy2", "cx2", F.lit(float(hop)))
    reach, last = 2, at.agg(F.max("n")).first()[0] or 0
    d = distance("cy", "cx", "cy2", "cx2")
    while reach <= last and not open_.isEmpty():
        low, high, size = F.col("n") + reach, F.col("n") + 4 * reach - 1, 3 * reach
        sent = touching(open_, "cy", "cx", F.lit(float(hop))).withColumn("block", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        met = sent.join(b.withColumn("block", F.floor(F.col("n2") / size)).hint("merge"), ["recording_id", "block", "gy", "gx"]).withColumn("dist", d).where(F.col("n2").between(low, high) & (F.col("dist") <= hop))
        met = met.groupBy(*here).agg(F.min(F.struct("n2", "dist", "label2")).alias("m"))
        seen = staged(open_.join(met, here, "left").select(*here, "cy", "cx", F.col("m.n2").alias("next_n"), F.col("m.label2").alias("next_label")), "followers")
        found.append(seen.where("next_n is not null").drop("cy", "cx"))
        open_, reach = seen.where("next_n is null").drop("next_n", "next_label"), 4 * reach
    return functools.reduce(DataFrame.unionByName, found)


def chain(jump: DataFrame, start: DataFrame, last: int) -> DataFrame:
    """start (recording_id, n, label) and all that jump (recording_id, n, label, next_n, next_label) leads to from it, up to frame last.

    Frames are cut into blocks of 4, 16, 64 ... . Only places where some chain enters a block keep a jump out of it, made of four jumps of the
    level below at most, so that tables shrink from level to level; then the chain is unrolled from the largest block down.
    """
    here = ["recording_id", "n", "label"]
    block = lambda n, size: F.floor(F.col(n) / size)
    after = lambda rows: rows.select("recording_id", F.col("next_n").alias("n"), F.col("next_label").alias("label"))
    levels, size = [jump], 4
    while size <= last:
        below = levels[-1]
        far = below.select("recording_id", F.col("n").alias("next_n"), F.col("label").alias("next_label"), F.col("next_n").alias("far_n"), F.col("next_label").alias("far_label"))
        entries = after(below.where(block("n", size) != block("next_n", size))).unionByName(start.select(*here)).distinct()
        now = entries.join(below, here)
        for _ in range(3):
            inside = block("n", size) == block("next_n", size)
            far_ = far.withColumnsRenamed({c: f"_{c}" for c in far.columns})
            met = now.join(far_, (now["recording_id"] == far_["_recording_id"]) & (now["next_n"] == far_["_next_n"]) & (now["next_label"] == far_["_next_label"]) & inside, "left")
            now = met.select(*here, F.coalesce("_far_n", "next_n").alias("next_n"), F.coalesce("_far_label", "next_label").alias("next_label"))
        levels.append(staged(now.where(block("n", size) != block("next_n", size)), "jumps"))
        size *= 4
    reached = start.select(*here)
    for level in reversed(levels):
        front = reached
        for _ in range(3):
            front = after(front.join(level, here).where(block("n", size) == block("next_n", size)))
            reached = reached.unionByName(front)
        reached, size = staged(reached.distinct(), "reached"), size // 4
    return reached


def anchor_single(det: DataFrame, hop: float = 80.0) -> DataFrame:
    """The object that starts as the largest of the first occupied frame (lowest label among equals), followed by nearest centroid within hop; a miss keeps the anchor.

    Every place has one follower (nearest_later), and the chain from the start is found by levels of jumps (chain). No task follows a recording.
    """
    frames = det.select("recording_id", "frame").distinct().withColumn("_one", F.lit(1))
    order = running_sum(frames, ["recording_id"], "frame", "_one", "n").select("recording_id", "frame", F.col("n").cast("int").alias("n"))
    rows = staged(det.join(order, ["recording_id", "frame"]), "ordered")
    here = ["recording_id", "n", "label"]
    at = staged(positions(rows, ["recording_id", "n"]), "positions")
    last = rows.agg(F.max("n")).first()[0] or 0
    first = rows.where("n = 0").groupBy("recording_id").agg(F.max_by(F.struct("label", "cy", "cx"), F.struct("area_px", -F.col("label"))).alias("s"))
    first = staged(first.select("recording_id", F.lit(0).alias("n"), "s.*"), "first")
    # The start need not have the lowest label of its place, under which the place is followed.
    start = first.drop("label").join(at, ["recording_id", "n", "cy", "cx"]).select(*here)
    reached = chain(nearest_later(at, hop), start, last).where("n > 0").unionByName(first.select(*here))
    return rows.join(reached, here, "left_semi").select(*DET, "cy", "cx", "area_px")


def min_track_length(points: DataFrame, least: int = 8) -> DataFrame:
    """Tracks with at least so many frames that hold a point."""
    kept = valid(points).groupBy(*KEYS).agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= least)
    return points.join(kept.select(*KEYS), KEYS, "left_semi")


def division_lineage(lives: DataFrame, hop: float = 150.0, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """Parent of every track that starts after frame 0 where one ended in that frame or the one before, within hop, with
    an area ratio (child / parent) from low to high; the lowest parent id."""
    child = lives.where("first_frame > 0").select("recording_id", "track_id", F.col("first_frame").alias("division_frame"), "first_cy", "first_cx", "first_area", F.explode(F.array(F.col("first_frame") - 1, F.col("first_frame"))).alias("last_frame"))
    parent = lives.select("recording_id", F.col("track_id").alias("parent_id"), "last_frame", "last_cy", "last_cx", "last_area")
    ratio = F.col("first_area") / F.col("last_area")
    d = distance("first_cy", "first_cx", "last_cy", "last_cx")
    child, parent = touching(child, "first_cy", "first_cx", F.lit(float(hop))), squared(parent, "last_cy", "last_cx", F.lit(float(hop)))
    met = child.join(parent, ["recording_id", "last_frame", "gy", "gx"]).where((F.col("parent_id") != F.col("track_id")) & (d <= hop) & ratio.between(low, high))
    return met.groupBy(*KEYS, "division_frame").agg(F.min_by(F.struct("parent_id", ratio.alias("area_ratio")), "parent_id").alias("p")).select(*KEYS, "division_frame", "p.parent_id", "p.area_ratio")


def track_gaps(points: DataFrame) -> DataFrame:
    """Frames without a point strictly inside a track's life."""
    live = valid(points)
    life = live.groupBy(*KEYS).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    every = life.select(*KEYS, F.explode(F.sequence("a", "b")).alias("frame"))
    return every.join(live.select(*KEYS, "frame"), [*KEYS, "frame"], "left_anti")


def interpolate_centroid(points: DataFrame) -> DataFrame:
    """Position of every frame without a point: between its flanking points, or the one flank's."""
    p = fill_linear(fill_linear(points, KEYS, "frame", "cy", "_y"), KEYS, "frame", "cx", "_x")
    return p.where("cy is null or cx is null").select(*KEYS, "frame", F.col("_y").alias("cy"), F.col("_x").alias("cx"))


def _square(v: float) -> float:
    return math.pow(v, 2.0) if abs(v) < 1e150 else v * v


@F.pandas_udf(DoubleType())
def power_distance(dy: pd.Series, dx: pd.Series) -> pd.Series:
    """Distances whose squares are the C library's pow(x, 2), as DuckDB's are; a few in ten thousand squares differ from products in their last bit."""
    return pd.Series([math.sqrt(_square(y) + _square(x)) for y, x in zip(dy.tolist(), dx.tolist())], dtype="float64")


def nearest_detection(expected: DataFrame, det: DataFrame, radius: float = 30.0, min_area: int = 0) -> DataFrame:
    """The detection nearest to each expected point of its frame, closer than radius, of min_area pixels at least; lowest label among equals.

    Found among arrays of near places (nearest), so no pairs are shuffled, sorted or held; the few that are nearly the nearest are told apart by power_distance.
    """
    keys = ["recording_id", "frame"]
    wanted = staged(expected.select(*keys, F.col("track_id").alias("label"), "cy", "cx"), "expected")
    least = F.min(F.struct("label", "area_px"))
    near = det.where(F.col("area_px") >= min_area).join(wanted.select(*keys).distinct(), keys, "left_semi")
    at = staged(near.groupBy(*keys, "cy", "cx").agg(least.alias("p")).select(*keys, "p.label", "cy", "cx", "p.area_px"), "positions")
    seen = nearest(wanted, at, keys, radius * WIDER, ("area_px",))
    met = seen.select(*keys, F.col("label").alias("track_id"), F.explode("near").alias("p")).withColumn("dist", power_distance("p.dy", "p.dx")).where(F.col("dist") < radius)
    best = F.min(F.struct("dist", "p.label2", "p.cy", "p.cx", "p.area_px"))
    return met.groupBy(*KEYS, "frame").agg(best.alias("b")).select(*KEYS, "frame", F.col("b.label2").alias("label"), "b.cy", "b.cx", "b.area_px", "b.dist")


def fill_track_gaps(points: DataFrame, det: DataFrame, radius: float = 30.0, min_area: int = 0) -> DataFrame:
    """points with inner gaps filled from a second table of detections; is_filled marks the new ones."""
    gaps = interpolate_centroid(points).join(track_gaps(points), [*KEYS, "frame"], "left_semi")
    found = nearest_detection(gaps, det, radius, min_area).select(*KEYS, "frame", F.col("cy").alias("fy"), F.col("cx").alias("fx"))
    p = points.join(found, [*KEYS, "frame"], "left")
    return p.select(*KEYS, "frame", F.coalesce("cy", "fy").alias("cy"), F.coalesce("cx", "fx").alias("cx"), F.col("fy").isNotNull().alias("is_filled"))


def attach_labels(points: DataFrame, px: DataFrame) -> DataFrame:
    """Tracker points with the mask label under their rounded centroid (lowest where objects overlap), null on background."""
    m = px.groupBy("recording_id", "frame", "row_", "col_").agg(F.min("label").alias("label"))
    p = points.withColumn("row_", F.round("cy").cast("int")).withColumn("col_", F.round("cx").cast("int"))
    return p.join(m.hint("merge"), ["recording_id", "frame", "row_", "col_"], "left").drop("row_", "col_")


def import_track_masks(px: DataFrame, min_area: int = 60) -> DataFrame:
    """Track rows of a tracked label stack (label = track), for tracks whose largest area reaches min_area."""
    per = px.groupBy("recording_id", F.col("label").alias("track_id"), "frame").agg(F.avg("row_").alias("cy"), F.avg("col_").alias("cx"), F.count("*").alias("area_px"))
    over = W.partitionBy(*KEYS)
    return per.withColumn("first_frame", F.min("frame").over(over)).withColumn("_m", F.max("area_px").over(over)).where(F.col("_m") >= min_area).drop("_m")


def gap_sessions(events: DataFrame, keys: list[str], frame: str = "frame", max_gap: int = MAX_GAP) -> DataFrame:
    """Stretches of a key's frames in which no difference exceeds max_gap: session number, first and last frame, rows."""
    w = W.partitionBy(*keys).orderBy(frame)
    new = F.coalesce((F.col(frame) - F.lag(frame).over(w) > max_gap).cast("int"), F.lit(0))
    s = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*keys, "session").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n"))
