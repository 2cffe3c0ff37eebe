"""Start and end edges to spans and lifecycles: one shuffle each, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "process_key"


def _state(start: str = "start_ns", end: str = "end_ns") -> Column:
    """closed, open (no end), headless (no start) or negative (ends before it starts); spans() also tells doubled edges."""
    return F.when(F.col(end).isNull(), "open").when(F.col(start).isNull(), "headless").when(F.col(end) < F.col(start), "negative").otherwise("closed")


def spans(edges: DataFrame, carried: list[str], outcome: bool = True) -> DataFrame:
    """One row per (process, span_id) from start and done edges; a missing half stays null.

    More than one edge of a kind is a broken contract: the last ones are kept and the state is doubled.
    """
    at = lambda edge, c: F.max(F.when(F.col("edge") == edge, F.col(c)))
    out = [at("start", "timestamp_ns").alias("start_ns"), at("done", "timestamp_ns").alias("end_ns"), *([at("done", "outcome").alias("outcome")] if outcome else []), *[F.max(c).alias(c) for c in carried]]
    twice = F.greatest(F.count_if(F.col("edge") == "start"), F.count_if(F.col("edge") == "done")) > 1
    paired = edges.groupBy(KEY, "span_id").agg(*out, twice.alias("_twice")).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
    return paired.withColumn("state", F.when(F.col("_twice"), "doubled").otherwise(_state())).drop("_twice")


def lifecycles(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per (process, trace_id); a column that both halves have takes the end's value, else the start's."""
    common = [c for c in starts.columns if c in ends.columns and c not in (KEY, "trace_id", "timestamp_ns")]
    s = starts.withColumnRenamed("timestamp_ns", "start_ns").withColumnsRenamed({c: f"s_{c}" for c in common})
    e = ends.withColumnRenamed("timestamp_ns", "end_ns").withColumnsRenamed({c: f"e_{c}" for c in common})
    both = s.unionByName(e, allowMissingColumns=True)
    one = both.groupBy(KEY, "trace_id").agg(*[F.max(c).alias(c) for c in both.columns if c not in (KEY, "trace_id")])
    merged = one.select(*[c for c in one.columns if c[2:] not in common or c[:2] not in ("s_", "e_")], *[F.coalesce(f"e_{c}", f"s_{c}").alias(c) for c in common])
    return merged.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).withColumn("state", _state())


def record_phase(rows: DataFrame) -> DataFrame:
    """Rows with captured instants (start_ns, end_ns, outcome) as a start and a done edge."""
    edge = lambda name, at, outcome: F.struct(F.lit(name).alias("edge"), F.col(at).alias("timestamp_ns"), outcome.cast("string").alias("outcome"))
    edges = F.explode(F.array(edge("start", "start_ns", F.lit(None)), edge("done", "end_ns", F.col("outcome")))).alias("x")
    return rows.select(*[c for c in rows.columns if c not in ("start_ns", "end_ns", "outcome")], edges).select("*", "x.*").drop("x")


def finish_batch(packets: DataFrame, batches: DataFrame, by: list[str]) -> DataFrame:
    """Every packet of a batch gets the batch's one instant and one outcome; a batch without an end was dropped: abandoned."""
    ends = batches.select(*by, F.col("end_ns"), F.col("outcome"))
    return packets.join(ends, by, "left").withColumn("outcome", F.coalesce("outcome", F.lit("abandoned")))


def append(batches: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Packets in batches (columns by) after whole batches moved into others (columns by, to): one move each, not followed on."""
    moved = batches.join(moves, by, "left")
    return moved.withColumn(by[-1], F.coalesce("to", by[-1])).drop("to")


def pending_send(packets: DataFrame, batches: DataFrame, by: list[str]) -> DataFrame:
    """Every traced packet of a batch with the end of its lifecycle and of its send_queue phase: one instant, one outcome.

    Packets that are not traced (column traced) are not held.
    """
    ended = finish_batch(packets.where("traced").drop("traced"), batches, by)
    return ended.withColumns({"queue_end_ns": F.col("end_ns"), "queue_outcome": F.col("outcome")})


def empty_batches(batches: DataFrame, packets: DataFrame, by: list[str]) -> DataFrame:
    """Batches that hold no traced packet."""
    return batches.join(packets.where("traced").select(*by), by, "left_anti")


def socket_calls(calls: DataFrame, instants: Column) -> DataFrame:
    """Socket operations from system calls (start_ns, returned_ns, now_ns, outcome, buffers, datagrams, bytes).

    A call ends at the instant at which it returned, else now; only a call that succeeded
    has sizes; one without an outcome was given up. instants tells where the transport
    records anything: only there is the returned instant told to the packets.
    """
    ok = F.col("outcome") == "success"
    sizes = {c: F.when(ok, F.col(c)).otherwise(0).cast("long") for c in ("buffers", "datagrams", "bytes")}
    end = F.when(F.col("outcome").isNull(), F.col("now_ns")).otherwise(F.coalesce("returned_ns", "now_ns"))
    return calls.withColumns({**sizes, "end_ns": end, "instant_ns": F.when(instants, F.col("returned_ns")), "outcome": F.coalesce("outcome", F.lit("abandoned"))}).drop("returned_ns", "now_ns")


def carried_by_reads(packets: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of socket calls and packets that share an instant (column at): a sent packet ends where its send returned, a received one starts where its read returned.

    A call without a connection may have carried any connection's packets; n_candidates
    counts the calls that a packet agrees with, more than one being ambiguous.
    """
    both = packets.join(reads, [*keys, "at"]).where("socket_connection IS NULL OR socket_connection = connection_id")
    per = both.groupBy(*keys, "packet_id").agg(F.count("*").alias("n_candidates"))
    return both.join(per, [*keys, "packet_id"])
