"""Queries of the recorder's rules: what is enabled, who is traced, how calls, batches, scopes and identifiers behave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as G
from ..functions import masks
from ..operators import intervals, pairing
from ..schemas import EVENTS
from ..sources import text, wrappers
from ..sources.bridge import Bridge
from .queries import P, query

_BITS = {e: masks.bit(e) for e in EVENTS}


def _any_sql(mask: str, events: list[str]) -> str:
    return f"({mask} & {sum(_BITS[e] for e in events)}) <> 0"


# --- what is enabled --------------------------------------------------------


@query("SELECT event, provider, code FROM (VALUES " + ", ".join(f"('{e}', '{masks.provider(e)}', {b}::BIGINT)" for e, b in _BITS.items()) + ") AS t(event, provider, code)")
def event_registry(b: Bridge) -> DataFrame:
    rows = [(w.event, masks.provider(w.event), masks.bit(w.event)) for w in wrappers().values()]
    return b.spark.createDataFrame(rows, "event string, provider string, code bigint")


_M = "n % 512"


@query(
    f"SELECT n, {_any_sql(_M, masks.LIFECYCLES['packet'])} AS packet_traced, {_any_sql(_M, masks.LIFECYCLES['socket'])} AS socket_traced, {_any_sql(_M, masks.LIFECYCLES['blocked'])} AS blocked_traced, ({_M}) <> 0 AND {_any_sql(_M, masks.events('transport'))} AS transport_enabled, "
    f"CASE WHEN n % 3 = 0 THEN ({_M}) | {_BITS['udp_socket_end']} ELSE ({_M}) - (({_M}) & {_BITS['udp_socket_end']}) END AS after_set, {_BITS['quic_send_blocked']}::BIGINT AS after_only, CASE WHEN {_any_sql(_M, masks.events('transport'))} THEN ts_ns END AS reading_ns, "
    f"{_any_sql('n % 8', masks.LIFECYCLES['object'])} AND {_any_sql('n // 8 % 8', ['moq_object_phase'])} AS records_phases FROM {{base}}"
)
def mask_algebra(b: Bridge) -> DataFrame:
    m = F.col("n") % 512
    traced = [masks.traced(m, kind).alias(f"{kind}_traced") for kind in ("packet", "socket", "blocked")]
    phases = masks.records_phases(F.col("n") % 8, F.call_function("div", F.col("n"), F.lit(8)) % 8, "object")
    return b.base.select("n", *traced, masks.any_enabled(m, masks.events("transport")).alias("transport_enabled"), masks.set_enabled(m, "udp_socket_end", F.col("n") % 3 == 0).alias("after_set"), masks.enable_only("quic_send_blocked").alias("after_only"), masks.if_enabled(m, F.col("ts_ns")).alias("reading_ns"), phases.alias("records_phases"))


# an object begins under one mask (trace_id % 8) and its end leaves under another (trace_id // 8 % 8)
_START, _NOW = "trace_id % 8", "trace_id // 8 % 8"


@query(
    f"SELECT event, count(*) AS n, count(*) FILTER (traced) AS with_token, count(*) FILTER (traced AND now_on) AS emitted FROM (SELECT 'moq_object_start' AS event, {_any_sql(_START, masks.LIFECYCLES['object'])} AS traced, {_any_sql(_START, ['moq_object_start'])} AS now_on FROM {{object_start}} "
    f"UNION ALL SELECT 'moq_object_end', {_any_sql(_START, masks.LIFECYCLES['object'])}, {_any_sql(_NOW, ['moq_object_end'])} FROM {{object_end}}) GROUP BY event"
)
def disabled_tokens(b: Bridge) -> DataFrame:
    from ..sources import tagged

    stream = tagged({"moq_object_start": b.object_start.select(P, "trace_id"), "moq_object_end": b.object_end.select(P, "trace_id")})
    at_start = F.col("trace_id") % 8
    now = F.when(F.col("event") == "moq_object_start", at_start).otherwise(F.call_function("div", F.col("trace_id"), F.lit(8)) % 8)
    out = masks.emitted(F.col("event"), at_start, now, "object")
    return stream.groupBy("event").agg(F.count("*").alias("n"), F.count_if(masks.traced(at_start, "object")).alias("with_token"), F.count_if(out).alias("emitted"))


# --- columns ----------------------------------------------------------------


@query("SELECT process_key, trace_id, connection_id, connection_id // 8 AS session_id FROM {object_start}")
def stamped_context(b: Bridge) -> DataFrame:
    return G.stamped(b.object_start.select(P, "trace_id", "connection_id"), session_id=F.call_function("div", F.col("connection_id"), F.lit(8)))


@query("SELECT n, (n % 50) || ':' || (n % 7) AS id, (n % 50 < n % 40) OR (n % 50 = n % 40 AND n % 7 < n % 5) AS before, n % 50 = n % 40 AND n % 7 = n % 5 AS same, n % 50 IS NOT DISTINCT FROM CASE WHEN n % 3 <> 0 THEN n % 40 END AS same_group FROM {base}")
def logical_id_order(b: Bridge) -> DataFrame:
    n = F.col("n")
    one, other = G.logical_id(n % 50, n % 7), G.logical_id(n % 40, n % 5)
    return b.base.select("n", G.logical_text(one).alias("id"), (one < other).alias("before"), G.same(one, other).alias("same"), G.same(n % 50, F.when(n % 3 != 0, n % 40)).alias("same_group"))


@query("SELECT n, CASE WHEN errno = 0 THEN NULL WHEN errno = 11 THEN 'would_block' WHEN errno = 104 THEN 'connection_reset' WHEN errno IS NOT NULL THEN 'error' END AS by_kind, CASE WHEN n % 2 = 0 THEN CASE WHEN errno = 0 THEN 'success' WHEN errno = 11 THEN 'would_block' WHEN errno = 104 THEN 'connection_reset' WHEN errno IS NOT NULL THEN 'error' END WHEN errno = 11 THEN 'would_block' WHEN errno = 104 THEN 'connection_reset' WHEN errno > 0 THEN 'error' END AS by_code FROM {buffer}")
def io_error_outcome(b: Bridge) -> DataFrame:
    errno = F.col("errno")
    kind = F.when(errno == 11, "WouldBlock").when(errno == 104, "ConnectionReset").when(errno > 0, "Other")
    return b.buffer.select("n", G.io_error_outcome(kind).alias("by_kind"), G.io_error_outcome(kind, F.when(F.col("n") % 2 == 0, errno)).alias("by_code"))


@query("SELECT n, CASE n % 4 WHEN 0 THEN '00000000000000000000ffff' || lower(lpad(hex(n), 8, '0')) WHEN 1 THEN '20010db8' || lower(lpad(hex(n), 24, '0')) ELSE repeat('0', 32) END AS address, CASE WHEN n % 4 < 2 THEN (n * 7 % 65536)::INTEGER ELSE 0 END AS port FROM {base}")
def sockaddr_decode(b: Bridge) -> DataFrame:
    n = F.col("n")
    port, four = F.lpad(F.hex(n * 7 % 65536), 4, "0"), F.lpad(F.hex(n), 8, "0")
    v4 = F.concat(F.lit("0200"), port, four, F.lit("0" * 16))
    v6 = F.concat(F.lit("0A00"), port, F.lit("0" * 8), F.lit("20010DB8"), F.lpad(F.hex(n), 24, "0"), F.lit("0" * 8))
    raw = F.unhex(F.when(n % 4 == 0, v4).when(n % 4 == 1, v6).when(n % 4 == 2, F.concat(F.lit("0100"), port, four)))
    end = G.sockaddr_endpoint(raw)
    return b.base.select("n", F.lower(F.hex(end["address"])).alias("address"), end["port"].alias("port"))


@query("SELECT n, ts_ns // 1000000000 AS seconds, ts_ns % 1000000000 AS nanos, ts_ns AS clock_ns FROM {base}")
def clock_reading(b: Bridge) -> DataFrame:
    seconds, nanos = F.call_function("div", F.col("ts_ns"), F.lit(10**9)), F.col("ts_ns") % 10**9
    return b.base.select("n", seconds.alias("seconds"), nanos.alias("nanos"), G.clock_ns(seconds, nanos).alias("clock_ns"))


@query("SELECT n, CAST(least(CAST(n AS HUGEINT) * 1844674407370955, 9223372036854775807) AS BIGINT) AS saturated FROM {base}")
def saturating_cast(b: Bridge) -> DataFrame:
    return b.base.select("n", G.saturated(F.col("n").cast("decimal(20,0)") * F.expr("CAST(1844674407370955 AS DECIMAL(18,0))")).alias("saturated"))


@query("SELECT process_key, timestamp_ns, trace_id, stream_offset_end, payload_bytes, outcome FROM {object_end}")
def trace_text(b: Bridge) -> DataFrame:
    """Object ends printed as a trace reader prints them, and read from that text."""
    end = b.object_end
    has = F.col("stream_offset_end").isNotNull()
    raw = end.select(P, "timestamp_ns", "trace_id", has.cast("short").alias("has_stream_offset_end"), F.coalesce("stream_offset_end", F.lit(0)).alias("stream_offset_end"), "payload_bytes", G.enum_code("object_outcome", F.col("outcome")).alias("outcome"))
    lines = raw.select(text.written_line("moq_object_end").alias("line"))
    return text.event_rows(text.event_lines(lines), "moq_object_end")


# --- calls and batches ------------------------------------------------------


@query(
    "SELECT process_key, trace_id, connection_id, direction, start_ns, CASE WHEN errno IS NULL THEN now_ns ELSE coalesce(returned_ns, now_ns) END AS end_ns, CASE WHEN errno = 0 THEN 'success' WHEN errno = 11 THEN 'would_block' WHEN errno = 104 THEN 'connection_reset' WHEN errno IS NULL THEN 'abandoned' ELSE 'error' END AS outcome, "
    f"CASE WHEN errno = 0 THEN buffers ELSE 0 END AS buffers, CASE WHEN errno = 0 THEN datagrams ELSE 0 END AS datagrams, CASE WHEN errno = 0 THEN bytes ELSE 0 END AS bytes, CASE WHEN {_any_sql('mask', masks.events('transport'))} THEN returned_ns END AS instant_ns FROM {{system_call}}"
)
def socket_call(b: Bridge) -> DataFrame:
    calls = b.system_call.withColumn("outcome", G.errno_outcome(F.col("errno")))
    return pairing.socket_calls(calls, masks.any_enabled(F.col("mask"), masks.events("transport"))).drop("mask", "errno")


def _batches(b: Bridge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sent packets (batch, traced) after their batches' moves, the batches before the moves, and the ends of those left."""
    batch = F.lit(3000000000000) + (F.col("connection_id") * 16 + F.col("stream_id")) * 100000 + F.call_function("div", F.col("k"), F.lit(4))
    packets = b.packet.where("direction = 'tx'").select(P, "trace_id", batch.alias("batch_id"), (F.col("k") % 211 != 7).alias("traced"))
    moved = pairing.append(packets, b.batch_move.select(P, "batch_id", F.col("to_batch").alias("to")), [P, "batch_id"])
    ends = b.socket.where("direction = 'tx'").select(P, F.col("trace_id").alias("batch_id"), "end_ns", F.when(F.col("batch") % 7 == 5, "dropped").when(F.col("batch") % 7 != 6, "success").alias("outcome"))
    return moved, b.socket.where("direction = 'tx'").select(P, F.col("trace_id").alias("batch_id")), ends


_BATCH = "3000000000000 + (connection_id * 16 + stream_id) * 100000 + (CASE WHEN k // 4 % 5 = 1 THEN k // 4 - 1 ELSE k // 4 END)"


@query(f"SELECT p.process_key, p.trace_id, p.batch_id, s.end_ns, CASE s.batch % 7 WHEN 5 THEN 'dropped' WHEN 6 THEN 'abandoned' ELSE 'success' END AS outcome, s.end_ns AS queue_end_ns, CASE s.batch % 7 WHEN 5 THEN 'dropped' WHEN 6 THEN 'abandoned' ELSE 'success' END AS queue_outcome FROM (SELECT *, {_BATCH} AS batch_id FROM {{packet}} WHERE direction = 'tx' AND k % 211 <> 7) p JOIN {{socket}} s ON s.trace_id = p.batch_id AND s.connection_id = p.connection_id")
def pending_send(b: Bridge) -> DataFrame:
    packets, _, ends = _batches(b)
    return pairing.pending_send(packets, ends, [P, "batch_id"])


@query(f"SELECT process_key, trace_id AS batch_id FROM {{socket}} s WHERE direction = 'tx' AND NOT EXISTS (SELECT 1 FROM (SELECT {_BATCH} AS batch_id FROM {{packet}} WHERE direction = 'tx' AND k % 211 <> 7) p WHERE p.batch_id = s.trace_id)")
def empty_batches(b: Bridge) -> DataFrame:
    packets, batches, _ = _batches(b)
    return pairing.empty_batches(batches, packets, [P, "batch_id"])


# --- scopes -----------------------------------------------------------------

_IN_STEP = "SELECT w.process_key, w.seq, w.s, w.e, arg_max(p.step_id, p.s) AS step_id FROM {publish_wake} w JOIN {publish} p ON p.process_key = w.process_key AND p.thread_id = w.thread_id AND p.s <= w.s AND w.s < p.e GROUP BY w.process_key, w.thread_id, w.seq, w.s, w.e"


@query(
    f"SELECT * FROM (WITH i AS MATERIALIZED ({_IN_STEP}), m AS (SELECT process_key, step_id, least(row_number() OVER (PARTITION BY step_id ORDER BY seq), 4) AS slot, s, e FROM i), "
    "g AS MATERIALIZED (SELECT process_key, step_id, slot, min(s) AS s, max(e) AS e FROM m GROUP BY ALL), c AS (SELECT step_id, arg_max(e, slot) AS e FROM g GROUP BY step_id) "
    "SELECT process_key, step_id, CAST(slot AS INTEGER) AS slot, 'notify' AS piece, s, e, 'success' AS outcome FROM g "
    "UNION ALL SELECT g.process_key, g.step_id, CAST(g.slot AS INTEGER), 'step', coalesce(p.e, t.s), g.s, 'success' FROM g JOIN {publish} t ON g.step_id = t.step_id LEFT JOIN g p ON p.step_id = g.step_id AND p.slot = g.slot - 1 "
    "UNION ALL SELECT t.process_key, t.step_id, 5, 'step', coalesce(c.e, t.s), t.e, t.outcome FROM {publish} t LEFT JOIN c ON c.step_id = t.step_id)"
)
def nested_publish(b: Bridge) -> DataFrame:
    """Wakes split the innermost publish step only."""
    wakes = intervals.innermost(b.publish.select(P, "thread_id", "step_id", "s", "e"), b.publish_wake, [P, "thread_id"], "s", "step_id")
    return intervals.publish_pieces(b.publish, wakes.drop("thread_id"), [P, "step_id"])


_GAPS = (
    "SELECT process_key, fanout_id, g.s AS s, g.e AS e FROM (SELECT process_key, fanout_id, unnest(list_filter(list_transform(range(0, len(ks) + 1), lambda i: {{'s': CASE WHEN i = 0 THEN a ELSE ks[i].e END, 'e': CASE WHEN i = len(ks) THEN z ELSE ks[i + 1].s END}}), lambda g: g.s < g.e)) AS g FROM "
    "(SELECT process_key, fanout_id, a, z, list_filter(kept, lambda k: k.s < z) AS ks FROM (KEPT)))"
)
_KEPT = (
    "SELECT process_key, fanout_id, a, z, list_reduce(list_transform(coalesce(xs, []), lambda x: [x]), lambda acc, x: "
    "CASE WHEN x[1].e <= greatest(x[1].s, a, CASE WHEN len(acc) > 0 THEN acc[len(acc)].e ELSE a END) THEN acc WHEN len(acc) >= 8 THEN list_concat(acc[1:7], [{'s': acc[8].s, 'e': x[1].e}]) "
    "ELSE list_concat(acc, [{'s': greatest(x[1].s, a, CASE WHEN len(acc) > 0 THEN acc[len(acc)].e ELSE a END), 'e': x[1].e}]) END, CAST([] AS STRUCT(s BIGINT, e BIGINT)[])) AS kept FROM (REPORTS)"
)


def _kept_sql(reports: str) -> str:
    return _KEPT.replace("REPORTS", reports)


def _gaps_sql(reports: str) -> str:
    return _GAPS.replace("{{", "{").replace("}}", "}").replace("KEPT", _kept_sql(reports))


_CLOSES = "SELECT f.process_key, f.fanout_id, f.s, arg_min(c.at, c.seq) AS z, min(c.seq) AS closed FROM {fanout} f LEFT JOIN {fanout_close} c ON f.fanout_id = c.fanout_id GROUP BY ALL"
_CLOSED_REPORTS = f"SELECT f.process_key, f.fanout_id, f.s AS a, f.z, list({{'s': x.s, 'e': x.e}} ORDER BY x.seq) FILTER (x.seq < f.closed) AS xs FROM ({_CLOSES}) f LEFT JOIN {{excluded}} x ON f.fanout_id = x.fanout_id WHERE f.s IS NOT NULL AND f.z IS NOT NULL GROUP BY ALL".replace("{{'", "{'").replace("x.e}}", "x.e}")


@query(_gaps_sql(_CLOSED_REPORTS))
def fanout_close(b: Bridge) -> DataFrame:
    """The first close counts; what is excluded after it is lost."""
    keys = [P, "fanout_id"]
    ended, before = intervals.first_closes(b.fanout.select(*keys, "s"), b.fanout_close, b.excluded, keys)
    return intervals.notify_gaps(ended, before, keys)


def _reports(most: int) -> str:
    return f"SELECT f.process_key, f.fanout_id, f.s AS a, f.e AS z, list({{'s': x.s, 'e': x.e}} ORDER BY x.seq) FILTER (x.seq < {most} AND f.s IS NOT NULL) AS xs FROM {{fanout}} f LEFT JOIN {{excluded}} x ON f.fanout_id = x.fanout_id GROUP BY ALL"


@query(f"SELECT u.process_key, u.fanout_id, len(u.kept) AS n_held, u.kept = v.kept AS same FROM ({_kept_sql(_reports(99))}) u JOIN ({_kept_sql(_reports(9))}) v ON u.fanout_id = v.fanout_id")
def fanout_equality(b: Bridge) -> DataFrame:
    """Whether a fan-out equals itself without the reports from the tenth on."""
    keys = [P, "fanout_id"]
    one = intervals.kept_exclusions(b.fanout, b.excluded, keys)
    other = intervals.kept_exclusions(b.fanout, b.excluded.where("seq < 9"), keys).select(*keys, F.struct("s", "e", "held").alias("other"))
    return one.join(other, keys).select(*keys, F.size("held").cast("long").alias("n_held"), G.same(F.struct("s", "e", "held"), F.col("other")).alias("same"))


_PLAIN_REPORTS = "SELECT f.process_key, f.fanout_id, f.s AS a, f.e AS z, list({'s': x.s, 'e': x.e} ORDER BY x.seq) FILTER (x.seq IS NOT NULL) AS xs FROM {fanout} f LEFT JOIN {excluded} x ON f.fanout_id = x.fanout_id WHERE f.s IS NOT NULL AND f.e IS NOT NULL GROUP BY ALL"


@query(f"SELECT g.process_key, g.fanout_id, o.trace_id, g.s AS start_ns, g.e AS end_ns, 'notify' AS phase, 'success' AS outcome FROM ({_gaps_sql(_PLAIN_REPORTS)}) g JOIN {{object_start}} o ON o.trace_id = g.fanout_id + 1 AND o.direction = 'rx' WHERE {_any_sql('o.trace_id % 8', masks.LIFECYCLES['object'])} AND {_any_sql('o.trace_id % 8', ['moq_object_phase'])}")
def notify_spans(b: Bridge) -> DataFrame:
    """A fan-out's notify time as spans of the inbound object, where that records phases."""
    keys = [P, "fanout_id"]
    mask = F.col("trace_id") % 8
    inbound = b.object_start.where("direction = 'rx'").select(P, (F.col("trace_id") - 1).alias("fanout_id"), "trace_id", masks.records_phases(mask, mask, "object").alias("records"))
    return intervals.notify_spans(intervals.notify_gaps(b.fanout, b.excluded, keys), inbound, keys)


_ACTIVE = "SELECT {cols}, arg_max(f.fanout_id, f.s) AS fanout_id FROM {from} x JOIN {scoped} f ON f.process_key = x.process_key AND f.thread_id = x.thread_id AND f.s <= x.{at} AND x.{at} < f.e GROUP BY {cols}"


def _active(cols: str, rows: str, at: str) -> str:
    return _ACTIVE.replace("{cols}", cols).replace("{from}", rows).replace("{at}", at)


_WORK = _active("x.process_key, x.thread_id, x.copy_id, x.s, x.e", f"(SELECT e.*, b.s FROM {{copy_end}} e JOIN (SELECT process_key, thread_id, copy_id, arg_min(s, seq) AS s FROM ({_active('x.process_key, x.thread_id, x.copy_id, x.seq, x.s', '{copy_begin}', 'called_ns')}) GROUP BY ALL) b USING (process_key, thread_id, copy_id))", "e")
_SCOPED_REPORTS = f"SELECT f.process_key, f.fanout_id, f.s AS a, f.e AS z, list({{'s': x.s, 'e': x.e}} ORDER BY x.e, x.copy_id) FILTER (x.e IS NOT NULL) AS xs FROM {{scoped}} f LEFT JOIN ({_WORK}) x ON f.fanout_id = x.fanout_id GROUP BY ALL".replace("{{'", "{'").replace("x.e}}", "x.e}")


@query(_gaps_sql(_SCOPED_REPORTS))
def scoped_fanouts(b: Bridge) -> DataFrame:
    """Nested fan-outs: each copy's work is excluded from the one that is active when it ends."""
    thread, keys = [P, "thread_id"], [P, "fanout_id"]
    work = intervals.copy_work(b.scoped, b.copy_begin, b.copy_end, thread, "fanout_id", "copy_id")
    reports = work.select(*keys, F.struct("e", "copy_id").alias("seq"), "s", "e")
    return intervals.notify_gaps(b.scoped, reports, keys)


# --- counters and identifiers -----------------------------------------------


@query("SELECT kind, n, ids, least_id FROM (SELECT 'object' AS kind, count(*) AS n, count(DISTINCT trace_id) AS ids, min(trace_id) AS least_id FROM {object_start} UNION ALL SELECT 'packet', count(*), count(DISTINCT trace_id), min(trace_id) FROM {packet_start} UNION ALL SELECT 'object_span', count(*), count(DISTINCT span_id), min(span_id) FROM {object_phase} WHERE edge = 'start' UNION ALL SELECT 'blocked_span', count(*), count(DISTINCT span_id), min(span_id) FROM {blocked} WHERE edge = 'start')")
def id_allocation(b: Bridge) -> DataFrame:
    """Identifiers per kind: allocated, different, least; a process allocates each once, from 1."""
    from functools import reduce

    kinds = {"object": (b.object_start, "trace_id"), "packet": (b.packet_start, "trace_id"), "object_span": (b.object_phase.where("edge = 'start'"), "span_id"), "blocked_span": (b.blocked.where("edge = 'start'"), "span_id")}
    once = reduce(DataFrame.unionByName, [df.groupBy(F.lit(k).alias("kind"), P, F.col(c).alias("id")).agg(F.count("*").alias("m")) for k, (df, c) in kinds.items()])
    return once.groupBy("kind").agg(F.sum("m").alias("n"), F.count("*").alias("ids"), F.min("id").alias("least_id"))


@query("SELECT event, clock_reads, span_ids FROM (SELECT 'moq_object_start' AS event, count(*) AS clock_reads, 0::BIGINT AS span_ids FROM {object_start} UNION ALL SELECT 'moq_object_end', count(*), 0 FROM {object_end} UNION ALL SELECT 'moq_object_phase', count(*), count(*) FILTER (edge = 'start') FROM {object_phase} UNION ALL SELECT 'quic_send_blocked', count(*), count(*) FILTER (edge = 'start') FROM {blocked} UNION ALL SELECT 'udp_socket_end', count(*), 0 FROM {socket_end})")
def trace_counters(b: Bridge) -> DataFrame:
    """Clock readings and allocated span ids that the recorded events stand for."""
    from ..sources import counters, tagged

    tables = {"moq_object_start": b.object_start, "moq_object_end": b.object_end, "moq_object_phase": b.object_phase, "quic_send_blocked": b.blocked, "udp_socket_end": b.socket_end}
    return counters(tagged({k: df.select("timestamp_ns", *[c for c in ("edge",) if c in df.columns]) for k, df in tables.items()}))
