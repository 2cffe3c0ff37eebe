import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom import functions as G
from spanloom import plans
from spanloom.operators import correlate, intervals, pairing, quantiles
from spanloom.schemas import ENUMS, EVENTS, decoded_schema, raw_schema
from spanloom.sources import discard, enabled, read_event, recording, tagged, text, wrappers, write_events
from spanloom.sources.bridge import Bridge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize(
    ("start", "excluded", "close", "expected"),
    [
        (None, [], None, []),
        (100, [(110, 130), (125, 140), (90, 95), (160, 170)], None, []),
        (100, [(110, 130), (125, 140), (90, 95), (160, 170)], 180, [(100, 110), (140, 160), (170, 180)]),
        (0, [(10, 20)], 20, [(0, 10)]),
        (0, [(10 * i + 1, 10 * i + 2) for i in range(10)], 1000, [(0, 1), *[(10 * i + 2, 10 * i + 11) for i in range(7)], (92, 1000)]),
    ],
)
def test_fanout_golden(spark, start, excluded, close, expected):
    f = spark.createDataFrame([(1, start, close)], "k int, s long, e long")
    x = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(excluded)], "k int, seq int, s long, e long")
    assert sorted((r.s, r.e) for r in intervals.notify_gaps(f, x, ["k"]).collect()) == expected


def test_datagrams_and_errno_golden(spark):
    rows = [(1200, None, 1), (2500, 1200, 3), (800, 1200, 1), (0, 1200, 1), (1200, 0, 1)]
    df = spark.createDataFrame(rows, "b long, s long, want long").withColumn("got", G.datagrams(F.col("b"), F.col("s")))
    assert all(r.got == r.want for r in df.collect())
    codes = spark.createDataFrame([(0,), (11,), (104,), (105,), (90,), (None,)], "c int").select(G.errno_outcome(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["success", "would_block", "connection_reset", "error", "error", None]


def test_addresses_golden(spark):
    row = spark.range(1).select(F.hex(G.address(F.expr("0BD"), F.expr("281470849515521BD"))), F.hex(G.address(F.expr("2306139568115548160BD"), F.expr("7BD"))), F.hex(G.ipv4_mapped(F.lit("10.0.0.1"))), F.hex(G.address(F.expr("18446744073709551615BD"), F.expr("0BD")))).first()
    assert row[0] == row[2] == "00000000000000000000FFFF0A000001"
    assert row[1] == "20010DB8000000000000000000000007"
    assert row[3] == "F" * 16 + "0" * 16


def test_enums_are_per_kind_and_unknown_codes_survive(spark):
    assert [ENUMS[k].index("abandoned") for k in ("packet_outcome", "socket_outcome", "object_outcome")] == [4, 5, 2]
    assert spark.range(1).select(G.enum_label("packet_space", F.lit(9))).first()[0] == "unknown_9"
    assert spark.range(1).select(G.saturated(F.expr("18446744073709551615BD"))).first()[0] == 2**63 - 1


def test_pairing_states(spark):
    edges = recording(spark, "moq_object_phase", [("p", 10, 1, 1, "create", "start", None), ("p", 30, 1, 1, "create", "done", "failed"), ("p", 5, 1, 2, "notify", "start", None), ("p", 9, 1, 3, "clone", "done", "success"), ("p", 9, 1, 4, "clone", "start", None), ("p", 2, 1, 4, "clone", "done", "success"), ("q", 1, 1, 1, "create", "start", None)])
    got = {(r.process_key, r.span_id): (r.state, r.duration_ns, r.outcome) for r in pairing.spans(edges, ["trace_id", "phase"]).collect()}
    assert got == {("p", 1): ("closed", 20, "failed"), ("p", 2): ("open", None, None), ("p", 3): ("headless", None, "success"), ("p", 4): ("negative", -7, "success"), ("q", 1): ("open", None, None)}


def test_late_metadata_wins(spark):
    s = recording(spark, "quic_packet_start", [("p", 1, 7, 3, "rx", None, None, 1200)])
    e = recording(spark, "quic_packet_end", [("p", 9, 7, 91, "data", None, "success")])
    r = pairing.lifecycles(s, e).first()
    assert (r.packet_number, r.packet_space, r.byte_len, r.state) == (91, "data", 1200, "closed")


def test_bucketed_overlap_equals_plain(spark):
    rng = random.Random(3)
    side = lambda n: [(rng.randrange(2), a, a + rng.randrange(0, 60)) for a in (rng.randrange(500) for _ in range(n))]
    left = spark.createDataFrame(side(80), "k int, l_s long, l_e long")
    right = spark.createDataFrame(side(80), "k int, r_s long, r_e long")
    rows = lambda b: sorted(map(tuple, correlate.range_overlap(left, right, ["k"], b).select("k", "l_s", "l_e", "r_s", "r_e", "overlap").collect()))
    assert rows(None) == rows(16) == rows(7)


def test_union_length_against_sets(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, s, s + rng.randrange(0, 20)) for i, s in enumerate(rng.randrange(100) for _ in range(120))]
    got = {r.k: (r.total_ns, r.wall_ns) for r in intervals.union_length(spark.createDataFrame(rows, "k int, id int, s long, e long"), ["k"], "id").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert got[k] == (sum(e - s for *_, s, e in own), len({x for *_, s, e in own for x in range(s, e)}))


def test_overlap_bytes_are_conserved(spark):
    b = Bridge(spark, SF)
    assert b.frame.count() > 0
    total = plans.QUERIES["frame_object_overlap"](spark, SF).groupBy("object_id").agg(F.sum("bytes").alias("b")).join(b.object, F.col("object_id") == F.col("trace_id")).where("b > size").count()
    assert total == 0


def test_sources_round_trip(spark, tmp_path):
    assert all(len(raw_schema(e)) >= len(decoded_schema(e)) for e in EVENTS)
    ends = recording(spark, "udp_socket_end", [("p", 1, 2, "success", 1, 2, 3)])
    starts = recording(spark, "udp_socket_start", [("p", 0, 2, None, "tx"), ("p", 5, 3, 9, "rx")])
    stream = tagged({"udp_socket_end": ends, "udp_socket_start": starts})
    write_events(stream, str(tmp_path / "t"))
    back = spark.read.schema(decoded_schema("udp_socket_start")).parquet(str(tmp_path / "t" / "event=udp_socket_start"))
    assert sorted(map(str, back.collect())) == sorted(map(str, starts.collect()))
    assert read_event(spark, str(tmp_path / "t"), "udp_socket_end", raw=False).count() == 1
    assert enabled(stream, ["udp_socket_end"]).count() == 1
    discard(stream)
    with pytest.raises(ValueError):
        tagged({"other": ends})


def test_streams_pair_and_count(spark, tmp_path):
    from spanloom import streaming

    b = Bridge(spark, SF)
    source = str(tmp_path / "edges")
    b.object_phase.where("trace_id < 200").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    rows = streaming.run_once(spark, source, schema, streaming.paired, str(tmp_path / "out"))
    want = pairing.spans(spark.read.parquet(source), ["trace_id", "phase"]).where("state = 'closed'")
    assert sorted((r.span_id, r.start_ns, r.end_ns, r.outcome) for r in rows.where("state = 'closed'").collect()) == sorted((r.span_id, r.start_ns, r.end_ns, r.outcome) for r in want.collect())
    orphans = pairing.spans(spark.read.parquet(source), ["trace_id", "phase"]).where("state IN ('open', 'headless')")
    left = streaming.left_over(spark, str(tmp_path / "out"))
    assert sorted((r.span_id, r.state) for r in left.collect()) == sorted((r.span_id, r.state) for r in orphans.collect()) != []
    counts = streaming.run_once(spark, source, schema, streaming.window_counts, str(tmp_path / "counts"))
    assert counts.columns == ["start", "phase", "n"]


@pytest.mark.parametrize("gone", ["corpus_pipeline", "spanloom.llm"])
def test_entry_without_llm(spark, monkeypatch, gone):
    import importlib
    import sys

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setitem(sys.modules, gone, None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLES)
    sys.modules.pop("__spark_entry__", None)
    assert entry.entry(spark).columns == ["process_key", "rx_id", "tx_id", "rx_start_ns", "sent_ns", "bytes", "latency_ns"]
    assert os.path.isdir(SF)


def test_innermost_scopes(spark):
    """Against a stack: wakes and copies belong to the innermost scope of their thread."""
    rng = random.Random(8)
    scopes, points = [], []
    for thread in range(6):
        at, stack, own = 0, [], []
        for _ in range(60):
            at += rng.randrange(1, 4)
            what = rng.random()
            if what < 0.3:
                stack.append(len(scopes))
                scopes.append([thread, len(scopes), at, None])
            elif what < 0.6 and stack:
                scopes[stack.pop()][3] = at
            else:
                points.append((thread, len(points), at))
                own.append(stack[-1] if stack else None)
        while stack:
            at += 1
            scopes[stack.pop()][3] = at
    want = {}
    for thread, i, at in points:
        inside = [s for s in scopes if s[0] == thread and s[2] <= at < s[3]]
        if inside:
            want[i] = max(inside, key=lambda s: s[2])[1]
    got = intervals.innermost(spark.createDataFrame(scopes, "t int, id int, s long, e long"), spark.createDataFrame(points, "t int, i int, at long"), ["t"], "at", "id")
    assert {r.i: r.id for r in got.collect()} == want and len(want) > 50


def test_first_close_and_equality(spark):
    f = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "k int, s long")
    closes = spark.createDataFrame([(1, 5, 90), (1, 2, 50), (3, 1, 10)], "k int, seq int, at long")
    x = spark.createDataFrame([(1, 0, 10, 20), (1, 3, 60, 70), (2, 1, 5, 6), (3, 0, 1, 2)], "k int, seq int, s long, e long")
    ended, before = intervals.first_closes(f, closes, x, ["k"])
    assert sorted((r.k, r.s, r.e) for r in ended.collect()) == [(1, 0, 50), (2, 0, None), (3, None, None)]
    assert sorted((r.s, r.e) for r in intervals.notify_gaps(ended, before, ["k"]).collect()) == [(0, 10), (20, 50)]
    held = {r.k: [(h.s, h.e) for h in r.held] for r in intervals.kept_exclusions(ended, before, ["k"]).collect()}
    assert held == {1: [(10, 20)], 2: [(5, 6)], 3: []}


def test_as_of_in_cells_equals_plain(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.randrange(3), rng.randrange(1000), i) for i in range(300)], "k int, timestamp_ns long, i int")
    states = spark.createDataFrame([(rng.randrange(3), rng.randrange(1000), i) for i in range(25)], "k int, timestamp_ns long, v int")
    found = lambda cell: sorted(map(str, correlate.as_of(rows, states, ["k"], cell=cell).collect()))
    assert found(None) == found(1) == found(37) == found(5000)


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {1: rng.integers(-(10**6), 10**9, 4001), 2: rng.integers(0, 50, 500), 3: np.array([7]), 4: rng.integers(10**12, 2 * 10**12, 1000)}
    df = spark.createDataFrame([(k, int(v)) for k, vs in groups.items() for v in vs] + [(1, None)], "k int, v long")
    wanted = {"q0": 0.0, "q5": 0.5, "q9": 0.9, "q99": 0.99, "q100": 1.0}
    for r in quantiles.quantiles(df, ["k"], "v", wanted).collect():
        assert [r[n] for n in wanted] == pytest.approx([float(np.quantile(groups[r.k], q)) for q in wanted.values()], abs=1e-3)


def test_doubled_edges_are_told(spark):
    edges = recording(spark, "moq_object_phase", [("p", 10, 1, 1, "create", "start", None), ("p", 11, 1, 1, "create", "start", None), ("p", 30, 1, 1, "create", "done", "failed")])
    assert [(r.state, r.start_ns) for r in pairing.spans(edges, ["trace_id"]).collect()] == [("doubled", 11)]


def test_wrappers_check_their_event(spark):
    w = wrappers()["udp_socket_start"]
    rows = recording(spark, "udp_socket_start", [("p", 0, 2, None, "tx")])
    assert w.emit(rows).columns[-1] == "event" and w.emit(rows, F.lit(0).cast("long")).count() == 0
    with pytest.raises(ValueError):
        w.emit(rows.withColumn("other", F.lit(1)))


def test_trace_text(spark, tmp_path):
    """The contract fixture's cardinalities, printed as text and read back."""
    golden = {"moq_object_start": 12, "moq_object_end": 12, "moq_object_phase": 68, "quic_packet_start": 20, "quic_packet_end": 20, "quic_packet_phase": 200, "quic_stream_frame": 32, "udp_socket_start": 16, "udp_socket_end": 16, "quic_connection_path": 1, "quic_send_blocked": 24}
    raw = {}
    for event, n in golden.items():
        columns = [F.lit("host").alias("process_key")]
        for f in raw_schema(event)[1:]:
            top = 2 if f.name.startswith("has_") or f.name in ("edge", "direction", "retransmission") else 5
            columns.append((F.col("id") % top + (0 if top == 2 else f.name.count("t"))).cast(f.dataType).alias(f.name))
        raw[event] = spark.range(n).select(*columns)
    lines = [r[0] for event, df in raw.items() for r in df.select(text.written_line(event)).collect()]
    lines += ["", "no event", "[1] (+1) host other:event: { cpu_id = 0 }, { x = 1 }"]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    read = text.read_trace(spark, str(tmp_path / "t.txt"))
    assert {event: df.count() for event, df in read.items()} == golden and sum(golden.values()) == 421
    for event, df in read.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, G.decode(raw[event], event).collect()))
    odd = '[10:00:00.1] (+?.?) provider:moq_object_end: { cpu_id = 1 }, { vpid = 7, procname = "a" }, { timestamp_ns = 18446744073709551615, trace_id = 3, has_stream_offset_end = 0, stream_offset_end = 0, payload_bytes = 9, outcome = ( container = 77 ) }'
    (tmp_path / "o.txt").write_text(odd)
    row = text.event_rows(text.read_lines(spark, str(tmp_path / "o.txt")), "moq_object_end").first()
    assert (row.process_key, row.timestamp_ns, row.trace_id, row.stream_offset_end, row.outcome) == ("7", None, 3, None, "unknown_77")


def test_streams_keep_bounded_state(spark, tmp_path):
    from spanloom import streaming

    rng = random.Random(4)
    rows = []
    for scope in range(12):
        n = rng.choice([0, 1, 4, 8, 9, 40])
        rows += [("p", scope, i, 10 * i, 10 * i + rng.randrange(9), False) for i in range(n)] + [("p", scope, n, None, None, True)] * (scope % 5 != 4)
    schema = "process_key string, scope_id long, seq int, s long, e long, closes boolean"
    source = str(tmp_path / "reports")
    spark.createDataFrame(sorted(rows, key=lambda r: r[2]), schema).coalesce(1).sortWithinPartitions("seq").write.option("maxRecordsPerFile", 30).parquet(source)
    got = streaming.run_once(spark, source, spark.read.parquet(source).schema, lambda s: streaming.merged_intervals(s, 8), str(tmp_path / "out"))
    closed = [r for r in rows if r[1] % 5 != 4 and not r[5]]
    want = intervals.saturating_merge(spark.createDataFrame(closed, schema), ["process_key", "scope_id"], 8)
    shown = lambda df: sorted((r.scope_id, r.slot, r.s, r.e, r.merged) for r in df.collect())
    assert shown(got) == shown(want)


def test_streams_window_kinds_and_late_rows(spark, tmp_path):
    from spanloom import streaming

    second = 10**9
    schema = "process_key string, trace_id long, phase string, timestamp_ns long"
    batches = [[("p", 1, "a", 1), ("p", 1, "a", 12), ("p", 2, "a", 13)], [("p", 1, "a", 100)], [("p", 2, "a", 101), ("p", 2, "a", 300)], [("p", 1, "a", 2)], [("p", 1, "a", 700)]]
    source = tmp_path / "edges"
    source.mkdir()
    for i, rows in enumerate(batches):
        one = str(tmp_path / f"b{i}")
        spark.createDataFrame([(p, t, f, at * second) for p, t, f, at in rows], schema).coalesce(1).write.parquet(one)
        part = next(f for f in os.listdir(one) if f.endswith(".parquet"))
        os.rename(f"{one}/{part}", f"{source}/{i}.parquet")
        os.utime(f"{source}/{i}.parquet", (1000 + i, 1000 + i))
    run = lambda name, build: streaming.run_once(spark, str(source), spark.read.parquet(str(source)).schema, build, str(tmp_path / name), files=1)
    at = lambda v: int(v.timestamp())
    fixed = {(at(r.start), r.n) for r in run("w", lambda s: streaming.window_counts(s, "10 seconds", "30 seconds")).collect()}
    assert fixed == {(0, 1), (10, 2), (100, 2), (300, 1)}  # the second of 2 came after its window was done; that of 700 is still open
    sliding = {(at(r.start), r.n) for r in run("s", lambda s: streaming.window_counts(s, "10 seconds", "30 seconds", "5 seconds")).collect()}
    assert {(0, 1), (5, 2), (10, 2), (95, 2), (100, 2)} <= sliding and max(n for _, n in sliding) == 2
    sessions = {(r.trace_id, at(r.start), at(r.end), r.n) for r in run("x", lambda s: streaming.session_counts(s, "15 seconds", "30 seconds")).collect()}
    assert sessions == {(1, 1, 27, 2), (2, 13, 28, 1), (1, 100, 115, 1), (2, 101, 116, 1), (2, 300, 315, 1)}


def test_streams_pair_over_many_files(spark, tmp_path, monkeypatch):
    """Halves that meet in later batches, repeated edges, null ids and times; a bucket's ids share one call."""
    from spanloom import streaming

    calls = str(tmp_path / "calls")
    monkeypatch.setattr(streaming, "BUCKETS", 3)

    class Counting(streaming._Pairing):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as f:
                f.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(streaming, "_Pairing", Counting)
    big = 2**60
    batches = [
        [("p", i, big + i, "start", None) for i in range(300)] + [("q", None, 5, "start", None), ("p", 900, None, "start", None)],
        [("p", i, big + i + 7, "done", "ok" if i % 2 else None) for i in range(0, 300, 3)] + [("p", 400, 1, "done", "late")],
        [("p", i, big + i - 1, "done", "x") for i in range(1, 300, 3)] + [("q", None, 9, "done", "n"), ("p", 2, big, "start", None)],
        [("p", 2, big + 1, "done", "one"), ("p", 2, big + 3, "done", "two")],
    ]
    source = tmp_path / "edges"
    schema = "process_key string, span_id long, timestamp_ns long, edge string, outcome string"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
    held: dict = {}
    want = []
    for batch in batches:
        for p, i, at, edge, result in batch:
            if at is not None:
                s, e, o = held.get((p, i), (None, None, None))
                held[p, i] = (at, e, o) if edge == "start" else (s, at, result)
        for k in [k for k, v in held.items() if v[0] is not None and v[1] is not None]:
            s, e, o = held.pop(k)
            want.append((*k, s, e, o, "negative" if e < s else "closed"))
    left = [(*k, s, e, o, "open" if e is None else "headless") for k, (s, e, o) in held.items()]
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    got = streaming.run_once(spark, str(source), spark.read.parquet(str(source)).schema, streaming.paired, str(tmp_path / "out"), files=1)
    assert order(got.collect()) == order(want)
    assert order(streaming.left_over(spark, str(tmp_path / "out")).collect()) == order(left) != []
    assert len(open(calls).read()) <= 5 * len(batches)


def test_stream_pairing_timeout(spark, tmp_path):
    from spanloom import streaming

    source, out = str(tmp_path / "edges"), str(tmp_path / "out")
    schema = "process_key string, span_id long, timestamp_ns long, edge string, outcome string"
    spark.createDataFrame([("p", i, 10 + i, "start" if i % 2 else "done", None) for i in range(20)], schema).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    stream = streaming.paired(spark.readStream.schema(schema).parquet(source), timeout_ms=200)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(processingTime="300 milliseconds").start(out)
    rows = []
    try:
        for _ in range(60):
            run.awaitTermination(1)
            rows = spark.read.schema(streaming.PAIRED).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(rows) >= 20:
                break
    finally:
        run.stop()
    assert sorted((r.span_id, r.state) for r in rows) == [(i, "open" if i % 2 else "headless") for i in range(20)]


def test_streams_merge_many_scopes_in_few_calls(spark, tmp_path, monkeypatch):
    """Scopes that go on over several batches; a bucket's scopes share one call."""
    from spanloom import streaming

    calls = str(tmp_path / "calls")
    monkeypatch.setattr(streaming, "BUCKETS", 2)

    class Counting(streaming._Merging):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as f:
                f.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(streaming, "_Merging", Counting)
    rng = random.Random(5)
    big = 2**60
    batches: list[list] = [[], [], [], []]
    for scope in range(200):
        n = rng.choice([0, 1, 3, 5, 12])
        cuts = sorted(rng.choice([0, 0, 1, 2]) for _ in range(n))
        for i, at in enumerate(cuts):
            batches[at].append(("p", scope, i, big + 10 * i - rng.randrange(30), big + 10 * i + rng.randrange(30), False))
        if scope % 5 != 4:
            batches[cuts[-1] if cuts and scope % 2 else 3].append(("p", scope, n, None, None, True))
    schema = "process_key string, scope_id long, seq int, s long, e long, closes boolean"
    source = tmp_path / "reports"
    for batch in batches:
        rng.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
    got = streaming.run_once(spark, str(source), spark.read.parquet(str(source)).schema, lambda s: streaming.merged_intervals(s, 4), str(tmp_path / "out"), files=1)
    closed = [r for batch in batches for r in batch if r[1] % 5 != 4 and not r[5]]
    want = intervals.saturating_merge(spark.createDataFrame(closed, schema), ["process_key", "scope_id"], 4)
    shown = lambda df: sorted((r.scope_id, r.slot, r.s, r.e, r.merged) for r in df.collect())
    assert shown(got) == shown(want)
    assert len(open(calls).read()) <= 2 * len(batches)
