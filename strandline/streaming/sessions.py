"""Structured Streaming forms of gap sessions and of the tracker."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from strandline.functions.staging import shared_dir, staged
from strandline.operators.linking import MAX_GAP, step_tracks

EPOCH = "2024-01-01 00:00:00"
#: The label of the row that ends a replay.
CLOSING = -1


def event_time(det: DataFrame, minutes: float = 60.0) -> DataFrame:
    """det with ts, the time of its frame."""
    return det.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.col("frame") * F.lit(int(minutes * 60))))


def gap_sessions(stream: DataFrame, keys: list[str], max_gap: int = MAX_GAP, minutes: float = 60.0, late: str = "24 hours") -> DataFrame:
    """Sessions of a key that end when no row follows within max_gap frames; rows later than the watermark are dropped."""
    gap = f"{int((max_gap * minutes) * 60) + 1} seconds"
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")).drop("w")


TRACKED = "recording_id string, track_id int, frame int, label int, cy double, cx double"
#: State of a recording: a map from track to its last position and frame, and the next free id with the last frame seen.
TRACKS, MARKS = ("track int", "cy double, cx double, frame int"), "next_id int, last_frame int"
#: Arrays of a packed row, and what their elements are: each row of a stream costs Python some ten microseconds before any work on it.
PACKED = {"label": "labels", "cy": "cys", "cx": "cxs"}
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Follower(StatefulProcessor):
    """Live tracks in a map state, of which a micro-batch reads all and writes those that moved, were born or died; a timer clears a recording that has ended."""

    def __init__(self, hop: float, max_gap: int, minutes: float):
        self.hop, self.max_gap, self.wait_ms = hop, max_gap, int(max_gap * minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks, self.marks = handle.getMapState("tracks", *TRACKS), handle.getValueState("marks", MARKS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        free, seen = self.marks.get() if self.marks.exists() else (0, -1)
        before = {int(k[0]): (float(v[0]), float(v[1]), int(v[2])) for k, v in self.tracks.iterator()}
        live, out = dict(before), []
        group = pd.concat(list(rows))
        each = pd.DataFrame({"frame": np.repeat(group["frame"].to_numpy(), group["labels"].map(len)), **{c: np.concatenate(group[many].to_list()) for c, many in PACKED.items()}})
        each = each.sort_values(["frame", "label"], kind="stable")
        for frame, now in each[each["frame"] > seen].groupby("frame", sort=True):
            owner, free = step_tracks(live, int(frame), now[["cy", "cx"]].to_numpy(float), self.hop, self.max_gap, True, free)
            out.append(now.assign(recording_id=key[0], track_id=np.array(owner, "int32")))
            seen = int(frame)
        for t in before.keys() - live.keys():
            self.tracks.removeKey((t,))
        for t, (y, x, f) in live.items():
            if before.get(t) != (y, x, f):
                self.tracks.updateValue((t,), (float(y), float(x), int(f)))
        self.marks.update((int(free), int(seen)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = int(group["ts"].max().timestamp() * 1000)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs() + 1) + self.wait_ms)
        if out:
            yield pd.concat(out)[["recording_id", "track_id", "frame", "label", "cy", "cx"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tracks.clear()
        self.marks.clear()
        return iter(())

    def close(self) -> None:
        pass


def packed(det: DataFrame, most: int = 4096) -> DataFrame:
    """Detections of a frame (with ts) as rows of at most so many consecutive labels, with arrays of labels and places."""
    rows = det.groupBy("recording_id", "frame", "ts", F.floor(F.col("label") / most)).agg(F.collect_list(F.struct("label", *[F.col(c).cast("double").alias(c) for c in ("cy", "cx")])).alias("_at"))
    return rows.select("recording_id", "frame", "ts", *[F.col(f"_at.{c}").alias(many) for c, many in PACKED.items()])


def tracker(stream: DataFrame, hop: float = 20.0, max_gap: int = MAX_GAP, late: str = "24 hours", minutes: float = 60.0) -> DataFrame:
    """Incremental linking per recording, as transformWithState over a map state of one entry a track (Follower); the session's state store must be RocksDB.

    Frames of a micro-batch are taken in order; rows behind the watermark and frames not after the last one seen are late and dropped; a
    track dies when max_gap frames pass without it, and the state of a recording when the watermark has passed that long. Rows are detections, or packed.
    """
    if "labels" not in stream.columns:
        stream = stream.select("recording_id", "frame", "ts", F.array("label").alias("labels"), *[F.array(F.col(c).cast("double")).alias(PACKED[c]) for c in ("cy", "cx")])
    timed = stream.withWatermark("ts", late).groupBy("recording_id")
    return timed.transformWithStateInPandas(Follower(hop, max_gap, minutes), TRACKED, "append", "EventTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, streams of the session keep their state in RocksDB."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def _replay(rows: DataFrame, operator, slices: int = 4, closing: DataFrame | None = None) -> DataFrame:
    """Run a streaming operator over a table appended slice by slice in order of time, and read what it wrote.

    closing, rows later than all others, is appended last, to carry the watermark past them. Slices are many files, and
    each is one micro-batch: a new query resumes from the checkpoint of the one before.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = staged(rows, "stream")
    cuts = rows.select(F.percentile_approx("frame", [k / slices for k in range(1, slices)])).first()[0] or []
    parts = [rows.where(F.lit(True) if low is None else F.col("frame") > low).where(F.lit(True) if high is None else F.col("frame") <= high) for low, high in zip([None, *cuts], [*cuts, None])]
    for part in [*parts, *([closing.select(*rows.columns)] if closing is not None else [])]:
        part.write.mode("append").parquet(f"{base}/in")
        result = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        query = result.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")


def replay_tracker(det: DataFrame) -> DataFrame:
    with rocksdb(det.sparkSession):
        return _replay(packed(event_time(det).withColumn("recording_id", F.col("recording_id").cast("string"))), tracker)


def replay_gap_sessions(det: DataFrame, late_frames: int = 24) -> DataFrame:
    """All sessions: a last row of no recording, later than the gap and the allowed lateness, closes those still open."""
    rows = event_time(det)
    end = rows.agg(F.max("frame").alias("last")).where("last is not null").select((F.col("last") + MAX_GAP + late_frames + 2).cast("int").alias("frame"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in det.dtypes if c not in ("frame", "label")]
    closing = event_time(end.select("frame", F.lit(CLOSING).alias("label"), *empty))
    return _replay(rows, lambda s: gap_sessions(s, ["recording_id", "label"]), closing=closing).where(~F.col("label").eqNullSafe(CLOSING))
