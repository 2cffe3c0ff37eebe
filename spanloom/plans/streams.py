"""Queries that run as streams: the rows come as files, pass through a stream to its end, and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..sources.bridge import Bridge
from .queries import P, _span_sql, _STATE, query

#: Seconds that the windows wait for late rows, as text for Spark and as a number for SQL.
LATE, LATE_NS = "30 seconds", 30 * 10**9


def _shared(b: Bridge) -> str:
    """A folder that all executors share: below the checkpoint folder, in local runs below the warehouse."""
    root = b.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not b.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = b.spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(b: Bridge, rows: DataFrame, build) -> tuple[DataFrame, str]:
    folder = _shared(b)
    rows.write.parquet(f"{folder}/in")
    return streaming.run_once(b.spark, f"{folder}/in", rows.schema, build, f"{folder}/out"), f"{folder}/out"


@query(f"SELECT process_key, span_id, start_ns, end_ns, {_STATE} FROM ({_span_sql('blocked', outcome=False).rstrip(', ').replace(',  FROM', ' FROM')})")
def stream_pairing(b: Bridge) -> DataFrame:
    """Spans as a stream pairs them, and what is still open in its state at the end."""
    edges = b.blocked.select(P, "span_id", "timestamp_ns", "edge", F.lit(None).cast("string").alias("outcome"))
    out, target = _streamed(b, edges, streaming.paired)
    return out.unionByName(streaming.left_over(b.spark, target)).select(P, "span_id", "start_ns", "end_ns", "state")


@query("SELECT process_key, scope_id, CAST(least(seq + 1, 8) AS INTEGER) AS slot, min(s) AS s, max(e) AS e, count(*) AS merged FROM {merge_in} GROUP BY ALL")
def stream_bounded_merge(b: Bridge) -> DataFrame:
    """A scope's intervals, at most eight of them held in the stream's state."""
    reports = b.merge_in.select(P, "scope_id", "seq", "s", "e", F.lit(False).alias("closes"))
    ends = b.base.select(P, F.col("n").alias("scope_id"), F.lit(99).alias("seq"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(True).alias("closes"))
    out, _ = _streamed(b, reports.unionByName(ends), lambda s: streaming.merged_intervals(s, 8))
    return out


def _windows_sql(width: int, slide: int) -> str:
    starts = f"(timestamp_ns // {slide * 10**9} - i) * {slide}"
    return f"SELECT start_s, phase, count(*) AS n FROM (SELECT phase, timestamp_ns, {starts} AS start_s FROM {{object_phase}}, range({width // slide}) AS r(i)) WHERE timestamp_ns // 1000 < (start_s + {width}) * 1000000 AND (start_s + {width}) * 1000000 <= (SELECT max(timestamp_ns) // 1000 - {LATE_NS // 1000} FROM {{object_phase}}) GROUP BY ALL"


def _phases(b: Bridge) -> DataFrame:
    return b.object_phase.select(P, "trace_id", "phase", "timestamp_ns")


@query(_windows_sql(3600, 3600))
def stream_windows(b: Bridge) -> DataFrame:
    """Edges per hour and phase, of the hours that the watermark has passed."""
    out, _ = _streamed(b, _phases(b), lambda s: streaming.window_counts(s, "1 hour", LATE))
    return out.select(F.unix_seconds("start").alias("start_s"), "phase", "n")


@query(_windows_sql(7200, 1800))
def stream_sliding_windows(b: Bridge) -> DataFrame:
    out, _ = _streamed(b, _phases(b), lambda s: streaming.window_counts(s, "2 hours", LATE, "30 minutes"))
    return out.select(F.unix_seconds("start").alias("start_s"), "phase", "n")


@query(
    "SELECT process_key, trace_id, CAST(min(t) AS BIGINT) AS start_us, CAST(max(t) + 1000 AS BIGINT) AS end_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY process_key, trace_id ORDER BY t) AS burst FROM "
    "(SELECT process_key, trace_id, timestamp_ns // 1000 AS t, CASE WHEN timestamp_ns // 1000 <= lag(timestamp_ns // 1000) OVER (PARTITION BY process_key, trace_id ORDER BY timestamp_ns // 1000) + 1000 THEN 0 ELSE 1 END AS new FROM {object_phase})) "
    f"GROUP BY process_key, trace_id, burst HAVING max(t) + 1000 <= (SELECT max(timestamp_ns) // 1000 - {LATE_NS // 1000} FROM {{object_phase}})"
)
def stream_sessions(b: Bridge) -> DataFrame:
    """Bursts of an object's edges: a millisecond without any ends one."""
    out, _ = _streamed(b, _phases(b), lambda s: streaming.session_counts(s, "1 millisecond", LATE))
    return out.select(P, "trace_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
