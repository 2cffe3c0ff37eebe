"""A synthetic trace made from the driver's events table; no captured trace exists.

Each table is one SELECT that Spark and DuckDB both run after small
substitutions, so a query and its SQL start from the same rows. Names in
braces are other tables of this module, or events itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SMALL = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS small(i)"

TABLES = {
    "base": "SELECT 'p0' AS process_key, event_id AS n, user_id + 1 AS connection_id, {ns} AS ts_ns, CAST(round(value * 100) AS BIGINT) AS size, 4 * (event_id % 3) + 2 AS stream_id FROM {events}",
    # inbound objects, and up to three copies of each on other connections
    "placed": "SELECT process_key, n, 0 AS k, n + 1 AS trace_id, n + 1 AS logical_group, 'rx' AS direction, connection_id, stream_id, size, ts_ns AS start_ns, ts_ns + size * 10 AS end_ns FROM {base} "
    "UNION ALL SELECT process_key, n, i + 1, 1000000000 + 4 * n + i, CASE WHEN n % 89 = 0 THEN 1000000000 + n ELSE n + 1 END, 'tx', 1000000 + (connection_id + i * 7) % 5000, 4 * ((n + i) % 3) + 3, size, ts_ns + size * 10 + 1000 * (i + 1), ts_ns + size * 18 + 1000 * (i + 1) FROM {base} JOIN {small} ON i < n % 4",
    "object": "SELECT *, CASE n % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'abandoned' WHEN 2 THEN 'expired' WHEN 3 THEN 'dropped' WHEN 4 THEN 'reset' ELSE 'success' END AS outcome, CAST(sum(size) OVER (PARTITION BY connection_id, stream_id ORDER BY trace_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS offset_end FROM {placed}",
    "object_start": "SELECT process_key, start_ns AS timestamp_ns, trace_id, logical_group, CAST(0 AS BIGINT) AS logical_frame, connection_id, direction, stream_id, offset_end - size AS stream_offset_start FROM {object} WHERE n % 101 <> 0",
    "object_end": "SELECT process_key, end_ns AS timestamp_ns, trace_id, CASE WHEN n % 83 <> 0 THEN offset_end END AS stream_offset_end, size AS payload_bytes, outcome FROM {object} WHERE n % 97 <> 0",
    "object_span": "SELECT process_key, trace_id, 40 * trace_id + j AS span_id, phase, start_ns + ((end_ns - start_ns) * a) DIV 20 AS s, start_ns + ((end_ns - start_ns) * b) DIV 20 AS e, outcome, n + j AS q FROM {object} JOIN "
    "(VALUES (0, 'header_parse', 0, 2), (1, 'payload_read', 2, 8), (2, 'transport_call', 3, 5), (3, 'payload_read', 9, 13), (4, 'transport_call', 9, 10), (5, 'transport_call', 11, 12), (6, 'write_blocked', 13, 15), (7, 'frame_commit', 15, 20), (8, 'delivery_wait', -3, 1)) AS p(j, phase, a, b) ON j < 6 + n % 4",
    "object_phase": "SELECT process_key, s AS timestamp_ns, trace_id, span_id, phase, 'start' AS edge, CAST(NULL AS {string}) AS outcome FROM {object_span} WHERE q % 127 <> 0 UNION ALL SELECT process_key, e, trace_id, span_id, phase, 'done', CASE WHEN q % 17 = 0 THEN 'failed' ELSE 'success' END FROM {object_span} WHERE q % 113 <> 0",
    # packets: one per 1200 bytes of a stream
    "stream": "SELECT process_key, connection_id, stream_id, direction, min(start_ns) AS first_ns, max(offset_end) AS length FROM {object} GROUP BY process_key, connection_id, stream_id, direction",
    "packet": "SELECT process_key, connection_id, stream_id, direction, k, 2000000000000 + (connection_id * 16 + stream_id) * 100000 + k AS trace_id, 1200 * k AS offset_start, least(1200 * (k + 1), length) AS offset_end, CASE WHEN direction = 'rx' THEN first_ns + (k DIV 4) * 20000 ELSE first_ns + k * 5000 END AS start_ns, first_ns + (k DIV 4) * 20000 + 19000 + (k DIV 4) % 3 AS end_ns FROM (SELECT *, {grid} AS k FROM {stream})",
    "packet_start": "SELECT process_key, start_ns AS timestamp_ns, trace_id, connection_id, direction, CASE WHEN k % 5 <> 0 THEN k END AS packet_number, CASE WHEN k % 5 <> 0 THEN 'data' END AS packet_space, CASE WHEN k % 3 = 0 THEN offset_end - offset_start + 40 END AS byte_len FROM {packet} WHERE k % 211 <> 7",
    "packet_end": "SELECT process_key, end_ns AS timestamp_ns, trace_id, k AS packet_number, 'data' AS packet_space, CASE WHEN k % 3 <> 0 THEN offset_end - offset_start + 40 END AS byte_len, CASE WHEN k % 29 = 0 THEN 'dropped' ELSE 'success' END AS outcome FROM {packet} WHERE k % 199 <> 3",
    "packet_span": "SELECT process_key, trace_id, direction, 8 * trace_id + j AS span_id, phase, start_ns + a * 500 AS s, CASE WHEN j = 3 THEN end_ns ELSE start_ns + b * 500 END AS e FROM {packet} JOIN (VALUES (0, 'scheduling', 0, 1), (1, 'frame_encode', 1, 3), (2, 'application', 3, 6), (3, 'send_queue', 6, 7), (4, 'read_queue', -4, 9)) AS p(j, phase, a, b) ON direction = 'tx' AND j < 4 OR direction = 'rx' AND j IN (0, 2, 4)",
    "frame": "SELECT process_key, start_ns + 100 AS timestamp_ns, trace_id, stream_id, offset_start, offset_end, 'success' AS outcome, CASE WHEN direction = 'tx' AND k % 4 <> 1 THEN k % 13 = 0 END AS retransmission FROM {packet} WHERE k % 157 <> 11",
    # one socket call for four packets
    "socket": "SELECT process_key, connection_id, direction, 3000000000000 + (connection_id * 16 + stream_id) * 100000 + k DIV 4 AS trace_id, max(CASE WHEN direction = 'rx' THEN start_ns ELSE end_ns END) AS end_ns, count(*) AS buffers, CAST(sum(offset_end - offset_start + 40) AS BIGINT) AS bytes, k DIV 4 AS batch FROM {packet} GROUP BY process_key, connection_id, direction, stream_id, k DIV 4",
    "socket_start": "SELECT process_key, end_ns - 700 AS timestamp_ns, trace_id, CASE WHEN trace_id % 5 <> 0 THEN connection_id END AS connection_id, direction FROM {socket} WHERE batch % 53 <> 5",
    "socket_end": "SELECT process_key, end_ns AS timestamp_ns, trace_id, CASE batch % 7 WHEN 5 THEN 'would_block' WHEN 6 THEN 'error' ELSE 'success' END AS outcome, buffers, buffers AS datagrams, bytes FROM {socket}",
    "blocked_span": "SELECT process_key, n + 1 AS span_id, connection_id, CASE WHEN n % 2 = 0 THEN stream_id END AS stream_id, CASE n % 6 WHEN 0 THEN 'congestion_window' WHEN 1 THEN 'pacing' WHEN 2 THEN 'amplification' WHEN 3 THEN 'connection_flow_control' WHEN 4 THEN 'stream_flow_control' ELSE 'send_buffer' END AS reason, ts_ns + 100 AS s, ts_ns + 100 + size * 3 * (n % 50 + 1) AS e FROM {base}",
    "blocked": "SELECT process_key, s AS timestamp_ns, span_id, connection_id, stream_id, reason, 'start' AS edge FROM {blocked_span} UNION ALL SELECT process_key, e, span_id, connection_id, stream_id, reason, 'done' FROM {blocked_span} WHERE span_id % 61 <> 0",
    "path": "SELECT process_key, ts_ns AS timestamp_ns, connection_id, n % 256 AS a, n % 65000 + 1 AS peer_port FROM {base} WHERE n % 25 = 0",
    # inputs of the interval rules
    "poll": "SELECT process_key, n AS call_id, i AS seq, ts_ns + i * 1000 AS s, ts_ns + i * 1000 + 300 + (n * 7 + i * 11) % 500 AS e, i = n % 5 AS last, n % 9 = 0 AS err FROM {base} JOIN {small} ON i <= n % 5",
    "nested": "SELECT process_key, n AS call_id, 12 * n + i AS span_id, ts_ns + i * 100 AS s, ts_ns + i * 100 + (n * 13 + i * 57) % 400 AS e FROM {base} JOIN {small} ON i <= n % 8",
    "merge_in": "SELECT process_key, n AS scope_id, i AS seq, ts_ns + i * 100 AS s, ts_ns + i * 100 + (n + i * 3) % 80 AS e FROM {base} JOIN {small} ON i < n % 12",
    "step": "SELECT process_key, n AS step_id, ts_ns AS s, ts_ns + 1000 AS e, CASE WHEN n % 13 = 0 THEN 'failed' ELSE 'success' END AS outcome FROM {base}",
    "wake": "SELECT process_key, n AS step_id, i AS seq, ts_ns + i * 130 + 10 AS s, ts_ns + i * 130 + 30 + (n + i) % 90 AS e FROM {base} JOIN {small} ON i < n % 7",
    "fanout": "SELECT process_key, n AS fanout_id, CASE WHEN n % 31 <> 0 THEN ts_ns END AS s, CASE WHEN n % 37 <> 0 THEN ts_ns + 1000 END AS e FROM {base}",
    "excluded": "SELECT process_key, n AS fanout_id, i AS seq, ts_ns + (i * 97 + n * 13) % 1100 - 20 AS s, ts_ns + (i * 97 + n * 13) % 1100 - 30 + (n + i * 5) % 60 AS e FROM {base} JOIN {small} ON i < n % 12",
    "buffer": "SELECT process_key, n, connection_id, size, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1200 ELSE 300 END AS segment, CASE n % 6 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 104 WHEN 3 THEN 105 WHEN 4 THEN 90 END AS errno FROM {base}",
    # nested scopes on one thread, what happens in them, and reports about them
    "publish": "SELECT process_key, n AS thread_id, 4 * n AS step_id, ts_ns AS s, ts_ns + 1000 AS e, 'success' AS outcome FROM {base} UNION ALL SELECT process_key, n, 4 * n + 1, ts_ns + 200, ts_ns + 600, CASE WHEN n % 13 = 0 THEN 'failed' ELSE 'success' END FROM {base} WHERE n % 3 = 0 UNION ALL SELECT process_key, n, 4 * n + 2, ts_ns + 300, ts_ns + 400, 'success' FROM {base} WHERE n % 6 = 0 UNION ALL SELECT process_key, n, 4 * n + 3, ts_ns + 600, ts_ns + 700, 'success' FROM {base} WHERE n % 3 = 0",
    "publish_wake": "SELECT process_key, n AS thread_id, i AS seq, ts_ns + i * 110 - 60 AS s, ts_ns + i * 110 - 40 + (n + i) % 30 AS e FROM {base} JOIN {small} ON i < 3 + n % 9",
    "scoped": "SELECT process_key, n AS thread_id, 2 * n AS fanout_id, ts_ns AS s, ts_ns + 1000 AS e FROM {base} UNION ALL SELECT process_key, n, 2 * n + 1, ts_ns + 300, ts_ns + 500 FROM {base} WHERE n % 4 = 0",
    "copy_begin": "SELECT process_key, n AS thread_id, i AS copy_id, j AS seq, ts_ns - 100 + i * 120 + j * 15 AS called_ns, ts_ns - 100 + i * 120 + j * 10 AS s FROM {base} JOIN {small} ON i < 2 + n % 8 JOIN (VALUES (0), (1)) AS twice(j) ON j <= (n + i) % 2",
    "copy_end": "SELECT process_key, n AS thread_id, i AS copy_id, ts_ns - 100 + i * 120 + 50 + (n + i) % 90 AS e FROM {base} JOIN {small} ON i < 2 + n % 8",
    "fanout_close": "SELECT process_key, n AS fanout_id, 4 + (n + 5 * i) % 9 AS seq, ts_ns + 700 + (n * 7 + i * 31) % 300 AS at FROM {base} JOIN {small} ON i < n % 4",
    "system_call": "SELECT process_key, n AS trace_id, connection_id, CASE WHEN n % 2 = 0 THEN 'tx' ELSE 'rx' END AS direction, ts_ns AS start_ns, CASE WHEN n % 5 <> 0 THEN ts_ns + 900 END AS returned_ns, ts_ns + 1500 AS now_ns, CASE n % 6 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 104 WHEN 3 THEN 105 WHEN 4 THEN 0 END AS errno, n % 7 + 1 AS buffers, n % 7 + 1 AS datagrams, size AS bytes, n % 512 AS mask FROM {base}",
    "batch_move": "SELECT DISTINCT process_key, trace_id AS batch_id, trace_id - 1 AS to_batch FROM {socket} WHERE direction = 'tx' AND batch % 5 = 1",
    "capture": "SELECT process_key, ts_ns + i * 700000 AS timestamp_ns, a AS local_last, peer_port, 1200 - i AS bytes FROM (SELECT process_key, ts_ns, n % 256 AS a, n % 65000 + 1 AS peer_port FROM {base} WHERE n % 25 = 0) AS seen JOIN {small} ON i < 5",
    "raw_packet": "SELECT process_key, n, ts_ns AS timestamp_ns, n + 1 AS trace_id, n % 3 AS direction, CASE WHEN n % 5 <> 0 THEN 1 ELSE 0 END AS has_packet_number, CASE WHEN n % 5 <> 0 THEN n % 1000 ELSE 0 END AS packet_number, CASE WHEN n % 7 <> 0 THEN 1 ELSE 0 END AS has_packet_space, CASE WHEN n % 7 <> 0 THEN n % 6 ELSE 0 END AS packet_space FROM {base}",
}
_SPARK = {"ns": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000", "grid": "explode(sequence(0L, (length - 1) DIV 1200))", "string": "STRING", "small": _SMALL}
_DUCK = {"ns": "epoch_us(ts) * 1000", "grid": "unnest(range(0, (length - 1) // 1200 + 1))", "string": "VARCHAR", "small": _SMALL}


def _names(sql: str) -> list[str]:
    return [x for x in re.findall(r"\{(\w+)\}", sql) if x not in _SPARK]


class Bridge:
    """The synthetic tables of one input folder, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._made: dict[str, DataFrame] = {"events": spark.read.parquet(f"{sf_dir}/events.parquet")}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._made and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            sql = TABLES[name]
            for key, value in _SPARK.items():
                sql = sql.replace("{" + key + "}", value)
            self._made[name] = self.spark.sql(sql, **{x: getattr(self, x) for x in _names(sql)})
        return self._made[name]


def duck_sql(sql: str) -> str:
    """SQL that names tables of this module in braces, with their definitions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in _names(text):
            if x in TABLES and x not in order:
                need(TABLES[x])
                order.append(x)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: _DUCK.get(m[1], f"b_{m[1]}" if m[1] in TABLES else m[1]), text).replace(" DIV ", " // ")
    tables = ",\n".join(f"b_{x} AS MATERIALIZED ({plain(TABLES[x])})" for x in order)
    return (f"WITH {tables}\n" if order else "") + plain(sql)
