"""Structured Streaming: start/done pairing as keyed state, and windowed counts.

There is no time range between a start and its end, so pairing keeps state per
(process, span) instead of a stream-stream join; what is still unpaired after
the timeout leaves as open or headless. The engine never invents an outcome.

A call of a processor costs far more than a row, so ids are dealt into buckets and a call
serves a bucket's rows; its state is a map, of which only what changes is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIRED = "process_key string, span_id bigint, start_ns bigint, end_ns bigint, outcome string, state string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of ids; a call of a processor serves all ids of one process and bucket, not one id.
BUCKETS = 1024
#: Ids of a call from which what its bucket holds is read in one go, not id by id.
WHOLE = 64


def _bucketed(rows: DataFrame, column: str) -> DataFrame:
    """rows with the bucket of an id; null ids have the bucket -1, and 0 in their place (a null would turn the column into floating point)."""
    bucket = F.coalesce(F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")), F.lit(-1))
    return rows.withColumn("bucket", bucket).withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def _held(state, ids: np.ndarray) -> dict[int, tuple]:
    """What a map state holds of these ids; more when it is read in one go."""
    if not state.exists():
        return {}
    if len(ids) >= WHOLE:
        return {k[0]: tuple(v) for k, v in state.iterator()}
    return {i: tuple(v) for i in ids.tolist() if (v := state.getValue((i,))) is not None}


class _Pairing(StatefulProcessor):
    """Holds the halves of a bucket's spans until the others come, or until their timer fires."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.half = handle.getMapState("half", "span_id bigint", "start_ns bigint, end_ns bigint, outcome string, due bigint")

    def _rows(self, key, spans: list, starts: list, ends: list, outcomes: list) -> pd.DataFrame:
        state = ["open" if e is None else "headless" if s is None else "negative" if e < s else "closed" for s, e in zip(starts, ends, strict=True)]
        own = [None] * len(spans) if key[1] < 0 else spans
        return pd.DataFrame({"process_key": pd.Series([key[0]] * len(spans), dtype=object), "span_id": pd.array(own, "Int64"), "start_ns": pd.array(starts, "Int64"), "end_ns": pd.array(ends, "Int64"), "outcome": pd.Series(outcomes, dtype=object), "state": state})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            spans, code = np.unique(pdf["span_id"].to_numpy(np.int64), return_inverse=True)
            first, at = (pdf["edge"] == "start").to_numpy(bool), pdf["timestamp_ns"].to_numpy(np.int64)
            results = pdf["outcome"].to_numpy(object)
            held = _held(self.half, spans)
            start, end, outcome = (np.full(len(spans), None, object) for _ in range(3))
            due = {}
            for i, span in enumerate(spans.tolist()) if held else ():
                if span in held:
                    start[i], end[i], outcome[i], due[i] = held[span]
            # of repeated edges the last one counts
            start[code[first]] = at[first]
            end[code[~first]] = at[~first]
            outcome[code[~first]] = [None if pd.isna(x) else x for x in results[~first]]
            both = np.array([s is not None and e is not None for s, e in zip(start, end, strict=True)], bool)
            now = None if self.timeout_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            for i in np.flatnonzero(~both).tolist():
                self.half.updateValue((int(spans[i]),), (None if start[i] is None else int(start[i]), None if end[i] is None else int(end[i]), outcome[i], due.get(i, now)))
            if now is not None and any(i not in due for i in np.flatnonzero(~both).tolist()):
                self.handle.registerTimer(now)
            for i in due:
                if both[i]:
                    self.half.removeKey((int(spans[i]),))
            if both.any():
                yield self._rows(key, spans[both].tolist(), start[both].tolist(), end[both].tolist(), outcome[both].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], *v) for k, v in self.half.iterator() if v[3] <= now] if self.half.exists() else []
        for x in gone:
            self.half.removeKey((x[0],))
        if gone:
            spans, starts, ends, outcomes, _ = (list(c) for c in zip(*gone, strict=True))
            yield self._rows(key, spans, starts, ends, outcomes)

    def close(self) -> None:
        pass


def paired(edges: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Spans of a stream of edges, each emitted once both halves came; an edge without a time is passed over.

    With a timeout (queries that run on) orphans leave as open or headless when
    it is over; without one (a run over what is there) they stay in the state store, from where left_over() reads them.
    """
    mode = "none" if timeout_ms is None else "processingTime"
    rows = _bucketed(edges.where(F.col("timestamp_ns").isNotNull()).select("process_key", "span_id", "timestamp_ns", "edge", "outcome"), "span_id")
    return rows.groupBy("process_key", "bucket").transformWithStateInPandas(_Pairing(timeout_ms), outputStructType=PAIRED, outputMode="append", timeMode=mode)


def left_over(spark: SparkSession, target: str) -> DataFrame:
    """The halves that a finished run of paired() still holds, as open and headless spans: a batch read of its state."""
    half = spark.read.format("statestore").option("stateVarName", "half").option("flattenCollectionTypes", "true").load(f"{target}-state")
    rows = half.select("key.process_key", F.when(F.col("key.bucket") >= 0, F.col("user_map_key.span_id")).alias("span_id"), "user_map_value.*")
    state = F.when(F.col("end_ns").isNull(), "open").otherwise("headless")
    return rows.select("process_key", "span_id", "start_ns", "end_ns", "outcome", state.alias("state"))


MERGED = "process_key string, scope_id bigint, slot int, s bigint, e bigint, merged bigint"


class _Merging(StatefulProcessor):
    """Holds the first intervals of a bucket's scopes; later ones extend the last. A scope's state is bounded by the slots, however long it is."""

    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "scope_id bigint", "s array<bigint>, e array<bigint>, merged array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["scope_id", "seq"], kind="stable")
        scopes, closes = new["scope_id"].to_numpy(np.int64), new["closes"].to_numpy(bool)
        ids = np.unique(scopes)
        ended = set(np.unique(scopes[closes]).tolist())
        wanted = set(ids.tolist())
        held = {i: v for i, v in _held(self.held, ids).items() if i in wanted}
        old = [(i, *x) for i, v in held.items() for x in zip(*v, strict=True)]
        columns = {"scope_id": scopes[~closes], "s": new["s"].to_numpy(np.int64)[~closes], "e": new["e"].to_numpy(np.int64)[~closes], "merged": np.ones((~closes).sum(), np.int64)}
        # what is held goes first
        every = pd.concat([pd.DataFrame(np.array(old, np.int64).reshape(-1, 4), columns=list(columns)), pd.DataFrame(columns)], ignore_index=True)
        every["slot"] = np.minimum(every.groupby("scope_id").cumcount().to_numpy(np.int64) + 1, self.slots)
        slots = every.groupby(["scope_id", "slot"], as_index=False).agg(s=("s", "min"), e=("e", "max"), merged=("merged", "sum"))
        done = slots["scope_id"].isin(ended)
        for i in ended & held.keys():
            self.held.removeKey((i,))
        for i, own in slots[~done].groupby("scope_id"):
            self.held.updateValue((int(i),), (own["s"].tolist(), own["e"].tolist(), own["merged"].tolist()))
        if done.any():
            out = slots[done]
            yield pd.DataFrame({"process_key": pd.Series([key[0]] * len(out), dtype=object), "scope_id": pd.array([None] * len(out) if key[1] < 0 else out["scope_id"].tolist(), "Int64"), "slot": out["slot"].to_numpy(np.int32), "s": out["s"].to_numpy(), "e": out["e"].to_numpy(), "merged": out["merged"].to_numpy()})

    def close(self) -> None:
        pass


def merged_intervals(reports: DataFrame, slots: int = 8) -> DataFrame:
    """Each scope's intervals as intervals.saturating_merge gives them, emitted when the scope closes.

    reports: process_key, scope_id, seq, s, e, closes; a scope's reports come in order of seq, the closing one last.
    """
    whole = reports.select("process_key", "scope_id", "seq", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "e")), "closes")  # a null would turn the column into floating point
    return _bucketed(whole, "scope_id").groupBy("process_key", "bucket").transformWithStateInPandas(_Merging(slots), outputStructType=MERGED, outputMode="append", timeMode="none")


def _timed(edges: DataFrame, late: str) -> DataFrame:
    """Rows with the payload's clock (nanoseconds) as the event time; what is later than the watermark is lost to windows."""
    return edges.withColumn("at", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000)))).withWatermark("at", late)


def window_counts(edges: DataFrame, width: str = "10 seconds", late: str = "30 seconds", slide: str | None = None) -> DataFrame:
    """Edges per window and phase; with slide the windows overlap."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return _timed(edges, late).groupBy(window, "phase").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "phase", "n")


def session_counts(edges: DataFrame, gap: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """Edges per trace and burst: a burst ends where nothing came for the gap."""
    return _timed(edges, late).groupBy(F.session_window("at", gap), "process_key", "trace_id").agg(F.count("*").alias("n")).select("process_key", "trace_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(spark: SparkSession, source: str, schema, build, target: str, mode: str = "append", files: int | None = None) -> DataFrame:
    """Runs build(stream of source) over all that is there now, that many files at a time, and returns the rows it wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reader = spark.readStream.schema(schema)
    stream = build((reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source))
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
