"""One function per query, (bridge) -> DataFrame, with its DuckDB SQL beside it.

The SQL is written from the rules, not from the plans: joins where the plans
use windows, recursion-free brute force where they use running values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as G
from ..operators import correlate, intervals, pairing, quantiles
from ..schemas import ENUMS
from ..sources.bridge import Bridge, duck_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
P = "process_key"


def query(sql: str | None = None):
    def add(f: Callable[[Bridge], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck_sql(sql)
        return f

    return add


_STATE = "CASE WHEN end_ns IS NULL THEN 'open' WHEN start_ns IS NULL THEN 'headless' WHEN end_ns < start_ns THEN 'negative' ELSE 'closed' END AS state"
_SPAN = "SELECT coalesce(a.process_key, b.process_key) AS process_key, coalesce(a.span_id, b.span_id) AS span_id, a.timestamp_ns AS start_ns, b.timestamp_ns AS end_ns, {more} FROM (SELECT * FROM {table} WHERE edge = 'start') a FULL JOIN (SELECT * FROM {table} WHERE edge = 'done') b ON a.process_key = b.process_key AND a.span_id = b.span_id"


def _span_sql(table: str, *carried: str, outcome: bool = True) -> str:
    more = ", ".join([*(["b.outcome"] if outcome else []), *[f"coalesce(a.{c}, b.{c}) AS {c}" for c in carried]])
    return _SPAN.replace("{more}", more).replace("{table}", "{" + table + "}")


_PACKET_EDGES = "SELECT process_key, s AS timestamp_ns, trace_id, span_id, phase, 'start' AS edge, CAST(NULL AS VARCHAR) AS outcome FROM {packet_span} UNION ALL SELECT process_key, e, trace_id, span_id, phase, 'done', 'success' FROM {packet_span} WHERE span_id % 131 <> 0"


# --- decoding ---------------------------------------------------------------


@query("SELECT process_key, trace_id, CASE WHEN has_packet_number = 1 THEN packet_number END AS packet_number, CASE WHEN has_packet_number = 1 AND packet_number = 0 THEN true ELSE false END AS is_zero FROM {raw_packet}")
def decode_optional(b: Bridge) -> DataFrame:
    number = G.optional(F.col("has_packet_number"), F.col("packet_number"))
    return b.raw_packet.select(P, "trace_id", number.alias("packet_number"), F.coalesce(number == 0, F.lit(False)).alias("is_zero"))


@query("SELECT process_key, trace_id, CASE direction WHEN 0 THEN 'rx' WHEN 1 THEN 'tx' ELSE 'unknown_' || direction END AS direction, CASE WHEN has_packet_space = 1 THEN CASE packet_space WHEN 0 THEN 'initial' WHEN 1 THEN 'handshake' WHEN 2 THEN 'zero_rtt' WHEN 3 THEN 'data' ELSE 'unknown_' || packet_space END END AS packet_space FROM {raw_packet}")
def decode_enum(b: Bridge) -> DataFrame:
    space = G.optional(F.col("has_packet_space"), G.enum_label("packet_space", F.col("packet_space")))
    return b.raw_packet.select(P, "trace_id", G.enum_label("direction", F.col("direction")).alias("direction"), space.alias("packet_space"))


@query("SELECT event, count(*) AS n, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM (SELECT 'moq_object_start' AS event, timestamp_ns FROM {object_start} UNION ALL SELECT 'udp_socket_end', timestamp_ns FROM {socket_end}) GROUP BY event")
def enabled_filter(b: Bridge) -> DataFrame:
    from ..sources import enabled, tagged

    stream = tagged({"moq_object_start": b.object_start, "moq_object_end": b.object_end, "udp_socket_end": b.socket_end})
    return enabled(stream, ["moq_object_start", "udp_socket_end"]).groupBy("event").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


@query("SELECT n, lower(hex(from_hex(lpad(hex(hi), 16, '0') || lpad(hex(lo), 16, '0')))) AS address, CASE WHEN n % 3 = 0 THEN '10.' || (n // 65536) % 256 || '.' || (n // 256) % 256 || '.' || n % 256 ELSE lower(lpad(hex(hi), 16, '0') || lpad(hex(lo), 16, '0')) END AS shown FROM (SELECT n, (CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 THEN 2306139568115548160 ELSE 18338657682652659712 END)::UBIGINT AS hi, (CASE WHEN n % 3 = 0 THEN 281470849515520 + n ELSE n END)::UBIGINT AS lo FROM {base})".replace("lower(hex(from_hex(lpad(hex(hi), 16, '0') || lpad(hex(lo), 16, '0'))))", "lower(lpad(hex(hi), 16, '0') || lpad(hex(lo), 16, '0'))"))
def address_decode(b: Bridge) -> DataFrame:
    n = F.col("n")
    high = F.when(n % 3 == 0, F.expr("0BD")).when(n % 3 == 1, F.expr("2306139568115548160BD")).otherwise(F.expr("18338657682652659712BD"))
    low = F.when(n % 3 == 0, n + F.lit(281470849515520)).otherwise(n)
    value = G.address(high, low)
    return b.base.select("n", F.lower(F.hex(value)).alias("address"), G.address_text(value).alias("shown"))


@query("SELECT n, CASE WHEN errno = 0 THEN 'success' WHEN errno = 11 THEN 'would_block' WHEN errno = 104 THEN 'connection_reset' WHEN errno IS NOT NULL THEN 'error' END AS outcome FROM {buffer}")
def errno_classification(b: Bridge) -> DataFrame:
    return b.buffer.select("n", G.errno_outcome(F.col("errno")).alias("outcome"))


@query("SELECT connection_id, count(*) AS buffers, CAST(sum(CASE WHEN segment > 0 THEN greatest(1, CAST(ceil(size / segment) AS BIGINT)) ELSE 1 END) AS BIGINT) AS datagrams, CAST(sum(size) AS BIGINT) AS bytes FROM {buffer} GROUP BY connection_id")
def gso_datagram_count(b: Bridge) -> DataFrame:
    return b.buffer.groupBy("connection_id").agg(F.count("*").alias("buffers"), F.sum(G.datagrams(F.col("size"), F.col("segment"))).alias("datagrams"), F.sum("size").alias("bytes"))


@query("SELECT d.direction, CAST(coalesce(sum(buffers), 0) AS BIGINT) AS buffers, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM (VALUES ('rx'), ('tx'), ('none')) AS d(direction) LEFT JOIN {socket} s ON s.direction = d.direction GROUP BY d.direction")
def socket_stats_sum(b: Bridge) -> DataFrame:
    sums = b.socket.groupBy("direction").agg(F.sum("buffers").alias("buffers"), F.sum("bytes").alias("bytes"))
    wanted = b.spark.createDataFrame([("rx",), ("tx",), ("none",)], "direction string")
    return wanted.join(sums, "direction", "left").select("direction", F.coalesce("buffers", F.lit(0)).alias("buffers"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


# --- pairing ----------------------------------------------------------------


def _per_trace_sql(edges: str, spans: str) -> str:
    """SQL for the spans of each trace as one text: the edges once, both halves joined."""
    shown = "string_agg(span_id || ':' || phase || ':' || coalesce(start_ns::VARCHAR, '-') || ':' || coalesce(end_ns::VARCHAR, '-') || ':' || coalesce(outcome, '-') || ':' || state, ',' ORDER BY span_id) AS spans"
    return f"SELECT * FROM (WITH edges AS MATERIALIZED ({edges}) SELECT process_key, trace_id, count(*) AS n_spans, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_ns, {shown} FROM (SELECT *, {_STATE} FROM ({spans})) GROUP BY process_key, trace_id)"


def _per_trace(spans: DataFrame) -> DataFrame:
    """The spans of each trace: how many, their length in all, and every one of them as text."""
    text = F.concat_ws(":", F.col("span_id").cast("string"), "phase", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("start_ns", "end_ns", "outcome")], "state")
    every = F.transform(F.sort_array(F.collect_list(F.struct("span_id", text.alias("text")))), lambda x: x["text"])
    return spans.groupBy(P, "trace_id").agg(F.count("*").alias("n_spans"), F.sum("duration_ns").alias("total_ns"), F.array_join(every, ",").alias("spans"))


def _object_spans(b: Bridge) -> DataFrame:
    return pairing.spans(b.object_phase, ["trace_id", "phase"])


@query(_per_trace_sql("SELECT * FROM {object_phase}", _span_sql("edges", "trace_id", "phase").replace("{edges}", "edges")))
def span_pairing_object(b: Bridge) -> DataFrame:
    return _per_trace(_object_spans(b))


def _packet_edges(b: Bridge) -> DataFrame:
    rows = b.packet_span.select(P, "trace_id", "span_id", "phase", F.col("s").alias("start_ns"), F.col("e").alias("end_ns"), F.lit("success").alias("outcome"))
    return pairing.record_phase(rows).where((F.col("edge") == "start") | (F.col("span_id") % 131 != 0))


@query(_per_trace_sql(_PACKET_EDGES, _span_sql("edges", "trace_id", "phase").replace("{edges}", "edges")))
def span_pairing_packet(b: Bridge) -> DataFrame:
    return _per_trace(pairing.spans(_packet_edges(b), ["trace_id", "phase"]))


@query(f"SELECT process_key, span_id, start_ns, end_ns, connection_id, stream_id, reason, end_ns - start_ns AS duration_ns, {_STATE} FROM ({_span_sql('blocked', 'connection_id', 'stream_id', 'reason', outcome=False)})")
def span_pairing_blocked(b: Bridge) -> DataFrame:
    return pairing.spans(b.blocked, ["connection_id", "stream_id", "reason"], outcome=False)


@query(f"SELECT *, end_ns - start_ns AS duration_ns, {_STATE} FROM (SELECT coalesce(s.process_key, e.process_key) AS process_key, coalesce(s.trace_id, e.trace_id) AS trace_id, s.timestamp_ns AS start_ns, e.timestamp_ns AS end_ns, s.connection_id, s.direction, e.outcome, coalesce(e.packet_number, s.packet_number) AS packet_number, coalesce(e.packet_space, s.packet_space) AS packet_space, coalesce(e.byte_len, s.byte_len) AS byte_len FROM {{packet_start}} s FULL JOIN {{packet_end}} e ON s.process_key = e.process_key AND s.trace_id = e.trace_id)".replace("{{", "{").replace("}}", "}"))
def packet_lifecycle(b: Bridge) -> DataFrame:
    return pairing.lifecycles(b.packet_start, b.packet_end)


_OBJECT_LIFE = f"SELECT *, end_ns - start_ns AS duration_ns, {_STATE} FROM (SELECT coalesce(s.process_key, e.process_key) AS process_key, coalesce(s.trace_id, e.trace_id) AS trace_id, s.timestamp_ns AS start_ns, e.timestamp_ns AS end_ns, logical_group, logical_frame, connection_id, direction, stream_id, stream_offset_start, stream_offset_end, payload_bytes, outcome FROM {{object_start}} s FULL JOIN {{object_end}} e ON s.process_key = e.process_key AND s.trace_id = e.trace_id)".replace("{{", "{").replace("}}", "}")


@query(_OBJECT_LIFE)
def object_lifecycle(b: Bridge) -> DataFrame:
    return pairing.lifecycles(b.object_start, b.object_end)


@query(f"SELECT *, end_ns - start_ns AS duration_ns, {_STATE} FROM (SELECT coalesce(s.process_key, e.process_key) AS process_key, coalesce(s.trace_id, e.trace_id) AS trace_id, s.timestamp_ns AS start_ns, e.timestamp_ns AS end_ns, connection_id, direction, outcome, buffers, datagrams, bytes FROM {{socket_start}} s FULL JOIN {{socket_end}} e ON s.process_key = e.process_key AND s.trace_id = e.trace_id)".replace("{{", "{").replace("}}", "}"))
def socket_lifecycle(b: Bridge) -> DataFrame:
    return pairing.lifecycles(b.socket_start, b.socket_end)


@query("WITH l AS (SELECT 'object' AS kind, s.timestamp_ns AS a, e.timestamp_ns AS z FROM {object_start} s FULL JOIN {object_end} e ON s.trace_id = e.trace_id UNION ALL SELECT 'packet', s.timestamp_ns, e.timestamp_ns FROM {packet_start} s FULL JOIN {packet_end} e ON s.trace_id = e.trace_id UNION ALL SELECT 'socket', s.timestamp_ns, e.timestamp_ns FROM {socket_start} s FULL JOIN {socket_end} e ON s.trace_id = e.trace_id UNION ALL SELECT 'object_phase', s.timestamp_ns, e.timestamp_ns FROM (SELECT * FROM {object_phase} WHERE edge = 'start') s FULL JOIN (SELECT * FROM {object_phase} WHERE edge = 'done') e ON s.span_id = e.span_id) SELECT kind, CASE WHEN z IS NULL THEN 'open' WHEN a IS NULL THEN 'headless' WHEN z < a THEN 'negative' ELSE 'closed' END AS state, count(*) AS n FROM l GROUP BY ALL".replace("WITH l AS", "SELECT * FROM (WITH l AS") + ")")
def unmatched_edges(b: Bridge) -> DataFrame:
    kinds = {"object": object_lifecycle(b), "packet": packet_lifecycle(b), "socket": socket_lifecycle(b), "object_phase": _object_spans(b)}
    rows = None
    for kind, df in kinds.items():
        one = df.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "state", "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT p.process_key, p.trace_id, s.end_ns, CASE s.batch % 7 WHEN 5 THEN 'dropped' WHEN 6 THEN 'abandoned' ELSE 'success' END AS outcome FROM {packet} p JOIN {socket} s ON p.connection_id = s.connection_id AND s.trace_id = 3000000000000 + (p.connection_id * 16 + p.stream_id) * 100000 + p.k // 4 WHERE p.direction = 'tx'")
def batch_completion(b: Bridge) -> DataFrame:
    batch = F.lit(3000000000000) + (F.col("connection_id") * 16 + F.col("stream_id")) * 100000 + F.call_function("div", F.col("k"), F.lit(4))
    ends = b.socket.select(P, F.col("trace_id").alias("batch_id"), "end_ns", F.when(F.col("batch") % 7 == 5, "dropped").when(F.col("batch") % 7 != 6, "success").alias("outcome"))
    packets = b.packet.where("direction = 'tx'").select(P, "trace_id", batch.alias("batch_id"))
    return pairing.finish_batch(packets, ends, [P, "batch_id"]).select(P, "trace_id", "end_ns", "outcome")


# --- interval rules ---------------------------------------------------------


@query("SELECT process_key, call_id, seq, s, e, CASE WHEN last AND err THEN 'failed' ELSE 'success' END AS outcome FROM {poll}")
def poll_measurement(b: Bridge) -> DataFrame:
    return b.poll.select(P, "call_id", "seq", "s", "e", intervals.poll_outcome(F.col("last"), F.col("err")).alias("outcome"))


@query("SELECT b.process_key, b.call_id, b.seq, a.e AS s, b.s AS e FROM {poll} a JOIN {poll} b ON a.call_id = b.call_id AND b.seq = a.seq + 1")
def wait_between_polls(b: Bridge) -> DataFrame:
    return intervals.waits(b.poll, [P, "call_id"])


@query("SELECT process_key, call_id, span_id, s, e FROM {nested} x WHERE NOT EXISTS (SELECT 1 FROM {nested} y WHERE y.call_id = x.call_id AND (y.s < x.s OR y.s = x.s AND (y.e > x.e OR y.e = x.e AND y.span_id < x.span_id)) AND y.e > x.s)")
def nested_call_outermost(b: Bridge) -> DataFrame:
    return intervals.outermost(b.nested, [P, "call_id"], "span_id")


@query("SELECT process_key, scope_id, least(seq + 1, 8) AS slot, min(s) AS s, max(e) AS e, count(*) AS merged FROM {merge_in} GROUP BY ALL")
def saturating_merge(b: Bridge) -> DataFrame:
    return intervals.saturating_merge(b.merge_in, [P, "scope_id"], 8)


@query(
    "SELECT * FROM (WITH m AS (SELECT process_key, step_id, least(seq + 1, 4) AS slot, min(s) AS s, max(e) AS e FROM {wake} GROUP BY ALL), "
    "c AS (SELECT step_id, max(slot) AS top, max(e) AS e FROM m GROUP BY step_id) "
    "SELECT process_key, step_id, slot, 'notify' AS piece, s, e, 'success' AS outcome FROM m "
    "UNION ALL SELECT m.process_key, m.step_id, m.slot, 'step', coalesce(p.e, t.s), m.s, 'success' FROM m JOIN {step} t ON m.step_id = t.step_id LEFT JOIN m p ON p.step_id = m.step_id AND p.slot = m.slot - 1 "
    "UNION ALL SELECT t.process_key, t.step_id, 5, 'step', coalesce(c.e, t.s), t.e, t.outcome FROM {step} t LEFT JOIN c ON c.step_id = t.step_id)"
)
def publish_split(b: Bridge) -> DataFrame:
    return intervals.publish_pieces(b.step, b.wake, [P, "step_id"])


@query(None)
def fanout_notify(b: Bridge) -> DataFrame:
    return intervals.notify_gaps(b.fanout, b.excluded, [P, "fanout_id"])


# The rule is a fold over reports: (floor, kept intervals). DuckDB folds the list of a fan-out's reports.
ORACLES["fanout_notify"] = duck_sql(
    "SELECT process_key, fanout_id, g.s AS s, g.e AS e FROM (SELECT process_key, fanout_id, unnest(list_filter(list_transform(range(0, len(ks) + 1), lambda i: {'s': CASE WHEN i = 0 THEN a ELSE ks[i].e END, 'e': CASE WHEN i = len(ks) THEN z ELSE ks[i + 1].s END}), lambda g: g.s < g.e)) AS g FROM "
    "(SELECT process_key, fanout_id, a, z, list_filter(kept, lambda k: k.s < z) AS ks FROM (SELECT process_key, fanout_id, a, z, list_reduce(list_transform(coalesce(xs, []), lambda x: [x]), lambda acc, x: "
    "CASE WHEN x[1].e <= greatest(x[1].s, a, CASE WHEN len(acc) > 0 THEN acc[len(acc)].e ELSE a END) THEN acc WHEN len(acc) >= 8 THEN list_concat(acc[1:7], [{'s': acc[8].s, 'e': x[1].e}]) "
    "ELSE list_concat(acc, [{'s': greatest(x[1].s, a, CASE WHEN len(acc) > 0 THEN acc[len(acc)].e ELSE a END), 'e': x[1].e}]) END, CAST([] AS STRUCT(s BIGINT, e BIGINT)[])) AS kept "
    "FROM (SELECT f.process_key, f.fanout_id, f.s AS a, f.e AS z, list({'s': x.s, 'e': x.e} ORDER BY x.seq) FILTER (x.seq IS NOT NULL) AS xs FROM {fanout} f LEFT JOIN {excluded} x ON f.fanout_id = x.fanout_id WHERE f.s IS NOT NULL AND f.e IS NOT NULL GROUP BY ALL))))"
)


@query("SELECT * FROM (WITH q AS (SELECT p.process_key, p.connection_id, s.s, s.e, s.span_id FROM {packet_span} s JOIN {packet} p ON s.trace_id = p.trace_id WHERE phase = 'read_queue'), r AS (SELECT *, max(e) OVER (PARTITION BY connection_id ORDER BY s, e, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id ORDER BY s, e, span_id) AS isl FROM r), w AS (SELECT process_key, connection_id, isl, max(e) - min(s) AS len FROM i GROUP BY ALL) SELECT a.process_key, a.connection_id, n, total_ns, wall_ns FROM (SELECT process_key, connection_id, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total_ns FROM q GROUP BY ALL) a JOIN (SELECT connection_id, CAST(sum(len) AS BIGINT) AS wall_ns FROM w GROUP BY ALL) c ON a.connection_id = c.connection_id)")
def queue_wall_time(b: Bridge) -> DataFrame:
    queued = b.packet_span.where("phase = 'read_queue'").join(b.packet.select(P, "trace_id", "connection_id"), [P, "trace_id"])
    return intervals.union_length(queued, [P, "connection_id"], "span_id")


@query("SELECT process_key, connection_id, stream_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY connection_id, stream_id ORDER BY s, e) AS isl FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY connection_id, stream_id ORDER BY s, e) = s THEN 0 ELSE 1 END AS new FROM (SELECT f.process_key, p.connection_id, f.stream_id, f.offset_start AS s, f.offset_end AS e FROM {frame} f JOIN {packet_start} p ON f.trace_id = p.trace_id))) GROUP BY process_key, connection_id, stream_id, isl")
def stream_coverage(b: Bridge) -> DataFrame:
    frames = b.frame.join(b.packet_start.select(P, "trace_id", "connection_id"), [P, "trace_id"]).select(P, "connection_id", "stream_id", F.col("offset_start").alias("s"), F.col("offset_end").alias("e"))
    return intervals.islands(frames, [P, "connection_id", "stream_id"]).drop("island")


# --- correlation ------------------------------------------------------------

_OVERLAP = (
    "SELECT * FROM (WITH o AS MATERIALIZED (SELECT s.process_key, s.trace_id, s.connection_id, s.stream_id, s.direction, s.stream_offset_start AS a, e.stream_offset_end AS z FROM {object_start} s JOIN {object_end} e ON s.trace_id = e.trace_id WHERE s.stream_offset_start < e.stream_offset_end), "
    "f AS MATERIALIZED (SELECT f.process_key, f.trace_id, p.connection_id, f.stream_id, p.direction, f.offset_start AS a, f.offset_end AS z FROM {frame} f JOIN {packet_start} p ON f.trace_id = p.trace_id WHERE f.offset_start < f.offset_end), "
    "j AS MATERIALIZED (SELECT o.process_key, o.trace_id AS object_id, f.trace_id AS packet_id, o.a AS oa, o.z AS oz, f.a AS fa, f.z AS fz FROM o JOIN f USING (process_key, connection_id, stream_id, direction)) "
    "SELECT process_key, object_id, packet_id, least(oz, fz) - greatest(oa, fa) AS bytes FROM j WHERE oa < fz AND fa < oz)"
)


#: Widths of the cells that range joins and as-of lookups deal a busy key into: bytes of a stream, nanoseconds.
CELL_BYTES, CELL_NS = 1 << 16, 1 << 22
PATH_NS = 60 * 10**9


def _overlap(b: Bridge, bucket: int = CELL_BYTES) -> DataFrame:
    keys = [P, "connection_id", "stream_id", "direction"]
    objects = object_lifecycle(b).where("start_ns IS NOT NULL AND stream_offset_end IS NOT NULL").select(*keys, F.col("trace_id").alias("object_id"), F.col("stream_offset_start").alias("l_s"), F.col("stream_offset_end").alias("l_e"))
    frames = b.frame.join(b.packet_start.select(P, "trace_id", "connection_id", "direction"), [P, "trace_id"]).select(*keys, F.col("trace_id").alias("packet_id"), F.col("offset_start").alias("r_s"), F.col("offset_end").alias("r_e"))
    return correlate.range_overlap(objects, frames, keys, bucket)


@query(_OVERLAP)
def frame_object_overlap(b: Bridge) -> DataFrame:
    return _overlap(b).select(P, "object_id", "packet_id", F.col("overlap").alias("bytes"))


@query(_OVERLAP)
def frame_object_overlap_bucketed(b: Bridge) -> DataFrame:
    return _overlap(b, 16384).select(P, "object_id", "packet_id", F.col("overlap").alias("bytes"))


def _sides(b: Bridge) -> tuple[DataFrame, DataFrame]:
    key = [P, "logical_group", "logical_frame"]
    rx = b.object_start.where("direction = 'rx'").select(*key, F.col("trace_id").alias("rx_id"), F.col("timestamp_ns").alias("rx_ns"))
    tx = b.object_start.where("direction = 'tx'").select(*key, F.col("trace_id").alias("tx_id"), F.col("timestamp_ns").alias("tx_ns"))
    return rx, tx


@query("SELECT r.process_key, r.logical_group, r.logical_frame, r.trace_id AS rx_id, t.trace_id AS tx_id, t.timestamp_ns - r.timestamp_ns AS relay_ns FROM {object_start} r JOIN {object_start} t ON r.logical_group = t.logical_group AND r.logical_frame = t.logical_frame WHERE r.direction = 'rx' AND t.direction = 'tx'")
def copy_pairing(b: Bridge) -> DataFrame:
    rx, tx = _sides(b)
    return rx.join(tx, [P, "logical_group", "logical_frame"]).select(P, "logical_group", "logical_frame", "rx_id", "tx_id", (F.col("tx_ns") - F.col("rx_ns")).alias("relay_ns"))


@query("SELECT process_key, logical_group, logical_frame, trace_id AS tx_id FROM {object_start} t WHERE direction = 'tx' AND NOT EXISTS (SELECT 1 FROM {object_start} r WHERE r.direction = 'rx' AND r.logical_group = t.logical_group AND r.logical_frame = t.logical_frame)")
def orphan_copies(b: Bridge) -> DataFrame:
    rx, tx = _sides(b)
    return tx.join(rx, [P, "logical_group", "logical_frame"], "left_anti").select(P, "logical_group", "logical_frame", "tx_id")


@query("SELECT process_key, logical_group, logical_frame, count(*) FILTER (direction = 'rx') AS n_rx FROM {object_start} GROUP BY ALL HAVING count(*) FILTER (direction = 'rx') <> 1")
def fanout_violations(b: Bridge) -> DataFrame:
    return b.object_start.groupBy(P, "logical_group", "logical_frame").agg(F.count_if(F.col("direction") == "rx").alias("n_rx")).where("n_rx <> 1")


@query("SELECT r.process_key, r.trace_id AS rx_id, count(t.trace_id) AS copies FROM {object_start} r LEFT JOIN {object_start} t ON t.direction = 'tx' AND r.logical_group = t.logical_group AND r.logical_frame = t.logical_frame WHERE r.direction = 'rx' GROUP BY ALL")
def fanout_degree(b: Bridge) -> DataFrame:
    rx, tx = _sides(b)
    per = tx.groupBy(P, "logical_group", "logical_frame").agg(F.count("*").alias("copies"))
    return rx.join(per, [P, "logical_group", "logical_frame"], "left").select(P, "rx_id", F.coalesce("copies", F.lit(0)).alias("copies"))


@query("SELECT p.process_key, p.trace_id, p.connection_id, p.timestamp_ns, x.timestamp_ns AS valid_from, x.peer_port FROM {packet_start} p ASOF LEFT JOIN {path} x ON p.connection_id = x.connection_id AND p.timestamp_ns >= x.timestamp_ns")
def path_asof(b: Bridge) -> DataFrame:
    paths = b.path.select(P, "connection_id", "timestamp_ns", "peer_port")
    return correlate.as_of(b.packet_start.select(P, "trace_id", "connection_id", "timestamp_ns"), paths, [P, "connection_id"], cell=PATH_NS)


@query("SELECT process_key, connection_id, timestamp_ns AS valid_from, lead(timestamp_ns) OVER (PARTITION BY process_key, connection_id ORDER BY timestamp_ns) AS valid_to, '10.0.0.' || a AS local_address, peer_port FROM {path}")
def path_validity(b: Bridge) -> DataFrame:
    local = G.address_text(G.ipv4_mapped(F.concat(F.lit("10.0.0."), F.col("a").cast("string"))))
    return correlate.valid_paths(b.path.select(P, "connection_id", "timestamp_ns", local.alias("local_address"), "peer_port"), [P, "connection_id"])


@query("SELECT p.process_key, p.direction, p.trace_id AS packet_id, s.trace_id AS socket_id, count(*) OVER (PARTITION BY p.process_key, p.direction, p.trace_id) AS n_candidates FROM (SELECT s.process_key, s.trace_id, s.connection_id, s.direction, e.timestamp_ns FROM {packet_start} s JOIN {packet_end} e ON s.trace_id = e.trace_id WHERE s.direction = 'tx' UNION ALL SELECT process_key, trace_id, connection_id, direction, timestamp_ns FROM {packet_start} WHERE direction = 'rx') p JOIN (SELECT s.process_key, s.trace_id, s.connection_id, s.direction, e.timestamp_ns FROM {socket_start} s JOIN {socket_end} e ON s.trace_id = e.trace_id) s ON p.process_key = s.process_key AND p.direction = s.direction AND p.timestamp_ns = s.timestamp_ns AND (s.connection_id IS NULL OR s.connection_id = p.connection_id)")
def socket_packet_completion(b: Bridge) -> DataFrame:
    own = [P, "direction", F.col("trace_id").alias("packet_id"), "connection_id"]
    sent = packet_lifecycle(b).where("state = 'closed' AND direction = 'tx'").select(*own, F.col("end_ns").alias("at"))
    received = b.packet_start.where("direction = 'rx'").select(*own, F.col("timestamp_ns").alias("at"))
    calls = socket_lifecycle(b).where("state = 'closed'").select(P, "direction", F.col("end_ns").alias("at"), F.col("trace_id").alias("socket_id"), F.col("connection_id").alias("socket_connection"))
    return pairing.carried_by_reads(sent.unionByName(received), calls, [P, "direction"]).select(P, "direction", "packet_id", "socket_id", "n_candidates")


_CLOSED = "SELECT a.process_key, a.trace_id, a.span_id, a.phase, a.timestamp_ns AS s, b.timestamp_ns AS e FROM {object_phase} a JOIN {object_phase} b ON a.span_id = b.span_id WHERE a.edge = 'start' AND b.edge = 'done'"


@query(f"SELECT *, e - s - nested_ns AS exclusive_ns FROM (SELECT p.process_key, p.trace_id, p.span_id, p.phase, p.s, p.e, CAST(coalesce(sum(c.e - c.s), 0) AS BIGINT) AS nested_ns FROM ({_CLOSED}) p LEFT JOIN ({_CLOSED}) c ON c.phase = 'transport_call' AND c.trace_id = p.trace_id AND c.s >= p.s AND c.e <= p.e WHERE p.phase NOT IN ('transport_call', 'delivery_wait', 'write_blocked') GROUP BY ALL)")
def phase_exclusive_time(b: Bridge) -> DataFrame:
    done = _object_spans(b).where("start_ns IS NOT NULL AND end_ns IS NOT NULL").select(P, "trace_id", "span_id", "phase", F.col("start_ns").alias("s"), F.col("end_ns").alias("e"))
    work = done.where(~F.col("phase").isin("transport_call", "delivery_wait", "write_blocked"))
    return correlate.contained_time(work, done.where("phase = 'transport_call'"), [P, "trace_id"], "span_id")


@query("SELECT process_key, trace_id, CAST(sum(CASE WHEN phase = 'application' THEN e - s ELSE 0 END) AS BIGINT) AS application_ns, CAST(max(e) - min(s) - sum(CASE WHEN phase = 'application' THEN e - s ELSE 0 END) AS BIGINT) AS transport_ns FROM {packet_span} GROUP BY ALL")
def packet_transport_share(b: Bridge) -> DataFrame:
    foreign = F.sum(F.when(F.col("phase") == "application", F.col("e") - F.col("s")).otherwise(0))
    return b.packet_span.groupBy(P, "trace_id").agg(foreign.alias("application_ns"), (F.max("e") - F.min("s") - foreign).alias("transport_ns"))


@query("SELECT p.process_key, x.end_ns, count(*) AS packets, max(p.e - p.s) AS longest_ns, count(*) FILTER (p.e <> x.end_ns) AS early FROM {packet_span} p JOIN {packet} x ON p.trace_id = x.trace_id WHERE phase = 'send_queue' GROUP BY ALL")
def send_queue_shared(b: Bridge) -> DataFrame:
    queued = b.packet_span.where("phase = 'send_queue'").join(b.packet.select(P, "trace_id", "end_ns"), [P, "trace_id"])
    return queued.groupBy(P, "end_ns").agg(F.count("*").alias("packets"), F.max(F.col("e") - F.col("s")).alias("longest_ns"), F.count_if(F.col("e") != F.col("end_ns")).alias("early"))


@query(
    "SELECT * FROM (WITH l AS MATERIALIZED (SELECT a.process_key, a.span_id, a.connection_id, a.timestamp_ns AS s, b.timestamp_ns AS e FROM {blocked} a JOIN {blocked} b ON a.span_id = b.span_id WHERE a.edge = 'start' AND b.edge = 'done' AND a.timestamp_ns < b.timestamp_ns), "
    "r AS MATERIALIZED (SELECT s.process_key, s.trace_id, s.connection_id, s.timestamp_ns AS s, e.timestamp_ns AS e FROM {packet_start} s JOIN {packet_end} e ON s.trace_id = e.trace_id WHERE s.timestamp_ns < e.timestamp_ns), "
    "j AS MATERIALIZED (SELECT l.process_key, span_id, l.connection_id, trace_id AS packet_id, l.s AS ls, l.e AS le, r.s AS rs, r.e AS re FROM l JOIN r ON l.process_key = r.process_key AND l.connection_id = r.connection_id) "
    "SELECT process_key, span_id, connection_id, packet_id, least(le, re) - greatest(ls, rs) AS overlap_ns FROM j WHERE ls < re AND rs < le)"
)
def blocked_overlap_packet(b: Bridge) -> DataFrame:
    keys = [P, "connection_id"]
    blocked = span_pairing_blocked(b).where("state = 'closed'").select(*keys, "span_id", F.col("start_ns").alias("l_s"), F.col("end_ns").alias("l_e"))
    packets = packet_lifecycle(b).where("state = 'closed'").select(*keys, F.col("trace_id").alias("packet_id"), F.col("start_ns").alias("r_s"), F.col("end_ns").alias("r_e"))
    return correlate.range_overlap(blocked, packets, keys, CELL_NS).select(P, "span_id", "connection_id", "packet_id", F.col("overlap").alias("overlap_ns"))


# --- reports ----------------------------------------------------------------


@query(f"SELECT process_key, trace_id, phase, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total_ns FROM ({_CLOSED}) GROUP BY ALL")
def phase_totals_per_object(b: Bridge) -> DataFrame:
    done = _object_spans(b).where("start_ns IS NOT NULL AND end_ns IS NOT NULL")
    return done.groupBy(P, "trace_id", "phase").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("total_ns"))


@query(f"SELECT o.direction, p.phase, count(*) AS n, CAST(sum(p.e - p.s) AS BIGINT) AS total_ns FROM ({_CLOSED}) p JOIN {{object_start}} o ON p.trace_id = o.trace_id GROUP BY ALL".replace("{{", "{").replace("}}", "}"))
def phase_totals(b: Bridge) -> DataFrame:
    return phase_totals_per_object(b).join(b.object_start.select(P, "trace_id", "direction"), [P, "trace_id"]).groupBy("direction", "phase").agg(F.sum("n").alias("n"), F.sum("total_ns").alias("total_ns"))


@query("SELECT direction, outcome, verdict, count(*) AS n FROM (SELECT s.direction, e.outcome, CASE WHEN outcome = 'success' THEN 'delivered' WHEN outcome IN ('expired', 'dropped', 'reset') THEN 'not delivered' WHEN outcome = 'failed' THEN 'error' WHEN outcome = 'abandoned' THEN 'unknown' ELSE 'open' END AS verdict FROM {object_start} s LEFT JOIN {object_end} e ON s.trace_id = e.trace_id) GROUP BY ROLLUP (direction, (outcome, verdict))")
def outcome_breakdown(b: Bridge) -> DataFrame:
    o = F.col("outcome")
    verdict = F.when(o == "success", "delivered").when(o.isin("expired", "dropped", "reset"), "not delivered").when(o == "failed", "error").when(o == "abandoned", "unknown").otherwise("open")
    rows = object_lifecycle(b).where("start_ns IS NOT NULL").select("direction", F.struct("outcome", verdict.alias("verdict")).alias("v"))
    return rows.rollup("direction", "v").agg(F.count("*").alias("n")).select("direction", "v.outcome", "v.verdict", "n")


@query(f"SELECT p.process_key, p.trace_id, o.connection_id, count(*) AS n, CAST(sum(p.e - p.s) AS BIGINT) AS wait_ns FROM ({_CLOSED}) p JOIN {{object_start}} o ON p.trace_id = o.trace_id WHERE o.direction = 'tx' AND p.phase = 'delivery_wait' GROUP BY ALL".replace("{{", "{").replace("}}", "}"))
def delivery_wait_by_copy(b: Bridge) -> DataFrame:
    waits = _object_spans(b).where("phase = 'delivery_wait' AND start_ns IS NOT NULL AND end_ns IS NOT NULL")
    copies = b.object_start.where("direction = 'tx'").select(P, "trace_id", "connection_id")
    return waits.join(copies, [P, "trace_id"]).groupBy(P, "trace_id", "connection_id").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("wait_ns"))


@query("SELECT * FROM (WITH q AS (SELECT a.process_key, a.connection_id, a.reason, a.span_id, a.timestamp_ns AS s, b.timestamp_ns AS e FROM {blocked} a JOIN {blocked} b ON a.span_id = b.span_id WHERE a.edge = 'start' AND b.edge = 'done'), r AS (SELECT *, max(e) OVER (PARTITION BY connection_id, reason ORDER BY s, e, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY connection_id, reason ORDER BY s, e, span_id) AS isl FROM r), w AS (SELECT process_key, connection_id, reason, isl, count(*) AS n, sum(e - s) AS t, max(e) - min(s) AS len FROM i GROUP BY ALL) SELECT process_key, connection_id, reason, CAST(sum(n) AS BIGINT) AS n, CAST(sum(t) AS BIGINT) AS total_ns, CAST(sum(len) AS BIGINT) AS wall_ns FROM w GROUP BY ALL)")
def blocked_time_by_reason(b: Bridge) -> DataFrame:
    done = span_pairing_blocked(b).where("start_ns IS NOT NULL AND end_ns IS NOT NULL").withColumnsRenamed({"start_ns": "s", "end_ns": "e"})
    return intervals.union_length(done, [P, "connection_id", "reason"], "span_id")


@query("SELECT f.retransmission, count(*) AS frames, CAST(sum(f.offset_end - f.offset_start) AS BIGINT) AS bytes FROM {frame} f JOIN {packet_start} p ON f.trace_id = p.trace_id WHERE p.direction = 'tx' GROUP BY ALL")
def retransmitted_bytes(b: Bridge) -> DataFrame:
    sent = b.frame.join(b.packet_start.where("direction = 'tx'").select(P, "trace_id"), [P, "trace_id"], "left_semi")
    return sent.groupBy("retransmission").agg(F.count("*").alias("frames"), F.sum(F.col("offset_end") - F.col("offset_start")).alias("bytes"))


@query("SELECT c.process_key, c.timestamp_ns, '10.0.0.' || c.local_last AS local_address, c.peer_port, c.bytes, p.connection_id FROM {capture} c JOIN (SELECT *, lead(timestamp_ns) OVER (PARTITION BY process_key, connection_id ORDER BY timestamp_ns) AS valid_to FROM {path}) p ON c.process_key = p.process_key AND c.local_last = p.a AND c.peer_port = p.peer_port AND c.timestamp_ns >= p.timestamp_ns AND (p.valid_to IS NULL OR c.timestamp_ns < p.valid_to)")
def path_address_join(b: Bridge) -> DataFrame:
    local = lambda c: G.address_text(G.ipv4_mapped(F.concat(F.lit("10.0.0."), F.col(c).cast("string")))).alias("local_address")
    paths = correlate.valid_paths(b.path.select(P, "connection_id", "timestamp_ns", local("a"), "peer_port"), [P, "connection_id"])
    captured = b.capture.select(P, "timestamp_ns", local("local_last"), "peer_port", "bytes")
    return correlate.address_join(paths, captured, [P, "local_address", "peer_port"]).select(P, "timestamp_ns", "local_address", "peer_port", "bytes", "connection_id")


_RELAY = f"SELECT r.process_key, r.trace_id AS rx_id, t.trace_id AS tx_id, r.timestamp_ns AS rx_start_ns, max(e.timestamp_ns) AS sent_ns, CAST(sum(v.bytes) AS BIGINT) AS bytes, max(e.timestamp_ns) - r.timestamp_ns AS latency_ns FROM {{object_start}} r JOIN {{object_start}} t ON r.logical_group = t.logical_group AND r.logical_frame = t.logical_frame JOIN ({_OVERLAP}) v ON v.object_id = t.trace_id JOIN {{packet_end}} e ON e.trace_id = v.packet_id WHERE r.direction = 'rx' AND t.direction = 'tx' GROUP BY r.process_key, r.trace_id, t.trace_id, r.timestamp_ns".replace("{{", "{").replace("}}", "}")


@query(_RELAY)
def relay_latency(b: Bridge) -> DataFrame:
    """Inbound object start to the last packet end that carries a byte of each copy."""
    rx, tx = _sides(b)
    pairs = rx.join(tx, [P, "logical_group", "logical_frame"]).select(P, "rx_id", "tx_id", F.col("rx_ns").alias("rx_start_ns"))
    carried = _overlap(b).where("direction = 'tx'").select(P, F.col("object_id").alias("tx_id"), F.col("packet_id").alias("trace_id"), "overlap")
    ends = b.packet_end.select(P, "trace_id", F.col("timestamp_ns").alias("sent"))
    last = carried.join(ends, [P, "trace_id"]).groupBy(P, "tx_id").agg(F.max("sent").alias("sent_ns"), F.sum("overlap").alias("bytes"))
    return pairs.join(last, [P, "tx_id"]).select(P, "rx_id", "tx_id", "rx_start_ns", "sent_ns", "bytes", (F.col("sent_ns") - F.col("rx_start_ns")).alias("latency_ns"))


@query(f"SELECT direction, phase, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90, round(quantile_cont(d, 0.99), 3) AS p99 FROM (SELECT o.direction, p.phase, p.e - p.s AS d FROM ({_CLOSED}) p JOIN {{object_start}} o ON p.trace_id = o.trace_id) GROUP BY ALL".replace("{{", "{").replace("}}", "}"))
def latency_percentiles(b: Bridge) -> DataFrame:
    done = _object_spans(b).where("start_ns IS NOT NULL AND end_ns IS NOT NULL").join(b.object_start.select(P, "trace_id", "direction"), [P, "trace_id"])
    found = quantiles.quantiles(done, ["direction", "phase"], "duration_ns", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("direction", "phase", *[F.round(c, 3).alias(c) for c in ("p50", "p90", "p99")])


@query("SELECT rx_id, tx_id, latency_ns FROM (" + _RELAY + ") ORDER BY latency_ns DESC, tx_id LIMIT 20")
def slowest_objects(b: Bridge) -> DataFrame:
    return relay_latency(b).select("rx_id", "tx_id", "latency_ns").orderBy(F.desc("latency_ns"), "tx_id").limit(20)


@query("SELECT kind, label, code FROM (VALUES " + ", ".join(f"('{k}', '{v}', {i})" for k, vs in ENUMS.items() for i, v in enumerate(vs)) + ") AS t(kind, label, code)")
def enum_codes(b: Bridge) -> DataFrame:
    rows = b.spark.createDataFrame([(k, v) for k, vs in ENUMS.items() for v in vs], "kind string, label string")
    code = F.coalesce(*[F.when(F.col("kind") == k, G.enum_code(k, F.col("label"))) for k in ENUMS])
    return rows.select("kind", "label", code.cast("int").alias("code"))
