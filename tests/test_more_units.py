"""Streams with restarts, checkpoints, patterns, folds and driver-side reporting."""

import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern import model
from quern.config import ControllerConfig, EnrichConfig, HeadConfig, RecordField, ReservoirConfig, TopNConfig
from quern.functions.hashing import record_hash, unit_interval
from quern.functions.matching import wildcard
from quern.operators import controller, enrich, folds, head, reservoir, telemetry, topn
from quern.sources import host, tables
from quern.streaming import stream
from quern.tunables import Tunable, TunableRegistry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_record_hash_of_a_whole_table(spark):
    rows = model.event_logs(spark, SF).select("body", record_hash(F.col("body")).alias("h")).collect()
    for r in rows:
        raw = r.body.encode()
        want = int.from_bytes(raw[:8], "big") ^ int.from_bytes(raw[8:], "big") if len(raw) == 16 else xxhash.xxh64_intdigest(raw)
        assert r.h % 2**64 == want


def test_unit_interval_rounds_as_unsigned(spark):
    rng = np.random.default_rng(0)
    values = [0, 1, -1, 2**63 - 1, -(2**63), 2**53 + 1, -(2**62) + 513, *map(int, rng.integers(-(2**63), 2**63, 2000))]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", unit_interval(F.col("v")).alias("u")).collect()
    assert all(r.u == float(r.v % 2**64) / 18446744073709551615.0 for r in rows)


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    df = spark.createDataFrame([("(?P<x>a)*",), ("aaa",), ("b[",), ("b[*",)], "t string")
    got = df.select("t", wildcard(F.col("t"), "(?P<x>a)*").alias("a"), wildcard(F.col("t"), "b[*").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (False, False), (False, False), (False, True)]


@pytest.mark.parametrize("k", [20, 1000, 5000])
def test_reservoirs_cut_each_part_first(spark, k):
    df = spark.range(20000).select(F.col("id").cast("string").alias("span_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 60).alias("ts"))
    out = reservoir.reservoir(df, k, "1 day", "span_id")
    assert plan(out).count("Window [row_number") == 2 and "hashpartitioning(window_start" in plan(out) and "shard" in plan(out)
    want = {r.span_id for r in df.orderBy(reservoir.keyed(F.col("span_id"), "reservoir"), "span_id").limit(k).collect()}
    assert {r.span_id for r in out.collect()} == want and ReservoirConfig().k == 5000


def test_last_step_holds_without_end(spark):
    p = spark.createDataFrame([("2024-01-01 00:00:00", 0.5), ("2024-03-01 10:00:00", 0.6), ("2024-03-01 10:20:00", 0.7)], "t string, p double").selectExpr("cast(t as timestamp) ts", "p")
    rows = spark.createDataFrame([(x,) for x in ("2023-12-31 00:00:00", "2024-01-01 00:00:00", "2024-02-20 01:02:03", "2024-03-01 10:19:59", "2024-03-01 10:20:00", "2040-01-01 00:00:00")], "t string").selectExpr("cast(t as timestamp) ts")
    got = [r.p for r in controller.probability_at(rows, p, 0.25).orderBy("ts").collect()]
    assert got == [0.25, 0.5, 0.5, 0.6, 0.7, 0.7]
    assert [r.p for r in controller.probability_at(rows, p.limit(0), 0.25).collect()] == [0.25] * 6


def test_many_steps_are_one_pass(spark):
    c = ControllerConfig(exporters=("e",))
    rows = spark.range(60000).selectExpr("id % 2 as c", "id as ts", "cast(id % 7 as double) / 6 as x")
    start = time.perf_counter()
    assert controller.steps(rows, c, 0.5, "c").count() == 60000
    assert time.perf_counter() - start < 30


def test_jumps():
    t = np.array([0, 1, 5, 5, 9, 10, 30])
    assert folds.jumps(t, 5, False).tolist() == [0, 2, 5, 6] and folds.jumps(t, 5, True).tolist() == [0, 4, 6]
    assert not len(folds.jumps(t[:0], 5, True))


def test_checkpoints_keep_their_counters(spark, tmp_path):
    spans = model.conversation_spans(spark, SF)
    path = str(tmp_path / "cp")
    assert tables.read_checkpoint(spark, path) is None and not tables.compact_checkpoint(spark, path, 0)
    tables.write_checkpoint(spans.limit(0), 7, 99, path)
    rows, seen, start = tables.read_checkpoint(spark, path)
    assert (rows.count(), seen, start) == (0, 7, 99)
    tables.write_checkpoint(spans, 8, 100, path)
    n = spans.count()
    assert not tables.compact_checkpoint(spark, path, 1 << 40) and tables.compact_checkpoint(spark, path, 0)
    rows, seen, start = tables.read_checkpoint(spark, path)
    assert (rows.count(), seen, start) == (n, 8, 100) and len(tables._versions(spark, path)) == 1


def test_tenant_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "tenant_id string, v long")
    tables.write_by_tenant(df, str(tmp_path / "batch"))
    assert {(r.tenant_id, r.v) for r in spark.read.parquet(str(tmp_path / "batch")).collect()} == {("a", 1), ("default", 2), ("default", 3)}
    df.write.parquet(str(tmp_path / "in"))
    q = stream.write_by_tenant(tables.read_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r.tenant_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "default"}


def files(spark, path, rows):
    spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, t string").selectExpr("trace_id", "span_id", "parent_span_id", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(str(path))


def collected(df, checkpoint, mode="append", pause=0.0):
    """What a stream emits until its input is read and ``pause`` has passed. Timeouts in
    processing time keep batches coming, so a stream with them is never at its end."""
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(checkpoint)).start()
    try:
        end = time.monotonic() + 60
        while not any(x["numInputRows"] for x in q.recentProgress) and time.monotonic() < end and q.isActive:
            time.sleep(0.1)
        time.sleep(pause)
    finally:
        q.stop()
    return got


def gather(spark, make, path, checkpoint, batches, pause=0.0):
    """Rows that a stream emits over runs with one checkpoint, a file each: a restart each."""
    out = []
    for rows in batches:
        files(spark, path, rows)
        df = make(spark.readStream.schema("trace_id string, span_id string, parent_span_id string, ts timestamp").parquet(str(path)))
        out.append(collected(df, checkpoint, pause=pause))
    return out


def test_trace_buffer_emits_spans(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    first = [("a", "1", "2", at + "1"), ("a", "2", "", at + "2"), ("a", "3", "2", at + "3"), ("b", "4", "x", at + "1"), ("c", "5", "x", at + "1")]
    second = [("b", "6", "", at + "5"), ("d", "7", "", at + "5")]
    flat = lambda rows: {(r.trace_id, r.n_spans, r.has_root, r.closed_by, tuple(s.span_id for s in r.spans)) for r in rows}
    got = gather(spark, lambda s: stream.trace_buffer(s, 600_000), tmp_path / "in", tmp_path / "cp", [first, second])
    assert flat(got[0]) == {("a", 2, True, "root", ("1", "2"))}  # 3 comes late and starts anew
    assert flat(got[1]) == {("b", 2, True, "root", ("4", "6")), ("d", 1, True, "root", ("7",))}  # b was held over the restart
    got = gather(spark, lambda s: stream.trace_buffer(s, 1000), tmp_path / "in2", tmp_path / "cp2", [first], 6.0)
    assert flat(got[0]) == {("a", 2, True, "root", ("1", "2")), ("a", 1, False, "timeout", ("3",)), ("b", 1, False, "timeout", ("4",)), ("c", 1, False, "timeout", ("5",))}


def test_streaming_reservoir_goes_on_after_a_restart(spark, tmp_path):
    spans = [("t", str(i), "", f"2024-01-01 00:00:{i % 60:02d}") for i in range(300)]
    later = [("t", "x", "", "2024-01-01 01:00:00"), ("t", "y", "", "2024-01-01 03:00:00")]
    make = lambda s: stream.stream_reservoir(s, 20, "1m", "span_id", "1 minute", shards=4)
    got = gather(spark, make, tmp_path / "in", tmp_path / "cp", [spans[:100], spans[100:], later, [("t", "z", "", "2024-01-01 05:00:00")]], 2.0)
    assert not got[0] and not got[1]  # the window is open: nothing is emitted
    parts = [r for g in got for r in g if r.window_start.hour == 0]
    df = spark.createDataFrame(parts, "window_start timestamp, shard int, seen long, place_draw array<string>, kept array<struct<trace_id:string,span_id:string,parent_span_id:string,ts:timestamp>>")
    rows = stream.merge_reservoir(df, 20).collect()
    all_ = spark.createDataFrame([(str(i),) for i in range(300)], "span_id string")
    want = {r.span_id for r in all_.orderBy(reservoir.keyed(F.col("span_id"), "reservoir"), "span_id").limit(20).collect()}
    assert {r.span_id for r in rows} == want and {r.window_seen for r in rows} == {300}


def test_process_states_expire(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "pid long, name string, value double, ts timestamp"
    out = []
    for rows in ([(1, "cpu", 0.9, 1), (1, "mem", 0.2, 2), (2, "cpu", 0.1, 1)], [(1, "cpu", 0.3, 20)]):
        spark.createDataFrame(rows, "pid long, name string, value double, s long").selectExpr("pid", "name", "value", "timestamp_seconds(s) ts").coalesce(1).write.mode("append").parquet(path)
        df = stream.process_states(spark.readStream.schema(schema).parquet(path), 1500, 0.5, 0.5)
        out.append([(r.pid, r.cpu, r.mem, r.evicted) for r in collected(df, tmp_path / "cp", "update", 6.0)])
    assert sorted(out[0]) == sorted([(1, 0.9, 0.2, False), (2, 0.1, 0.0, True), (1, 0.9, 0.2, True)])
    assert out[1] == [(1, 0.3, 0.0, True)]  # a new state, and never above


def test_control_loop_survives_a_restart(spark, tmp_path):
    c = ControllerConfig(exporters=("e",), alpha=1.0, patience=2, max_p=1.0)
    batch = spark.createDataFrame([("e", 9.0, 10.0)], "exporter string, queue_size double, queue_capacity double")

    def start():
        r = TunableRegistry()
        r.register(Tunable(c.target, {"probability": 0.5}))
        return r, stream.ControlLoop(c, r, str(tmp_path / "loop"), spark)

    registry, loop = start()
    loop(batch, 0)
    loop(batch, 0)  # a batch that is run again
    assert registry.get_value(c.target, "probability")[0] == pytest.approx(0.4)
    registry, loop = start()
    assert (loop.ewma, loop.run, loop.batch) == (0.9, 1, 0) and registry.get_value(c.target, "probability")[0] == pytest.approx(0.4)
    loop(batch, 1)  # the second in a row: the aggressive cut
    assert registry.get_value(c.target, "probability")[0] == pytest.approx(0.2)
    assert head.effective(HeadConfig(), registry) == pytest.approx(0.2) and head.effective(HeadConfig(probability=0.7)) == 0.7


def test_sample_with_the_probability_in_force(spark):
    r = TunableRegistry()
    r.register(Tunable("head", {"probability": 0.0}))
    seen = []
    call = stream.sample_with(r, "head", lambda df, p: df.filter(F.lit(p) > 0.5), lambda df, n: seen.append((n, df.count())))
    df = spark.range(5)
    call(df, 0)
    r.set_value("head", "probability", 1.0)
    call(df, 1)
    assert seen == [(0, 0), (1, 5)]


def test_breaker_states(spark):
    """Operations with several slow ones: what is let through, rejected and tried again."""
    log = [("a", i, i, ms, True) for i, ms in enumerate([200, 200, 200, 1, 1, 200, 1, 200])]
    rows = [(o, s * 30, q, float(m), k) for o, s, q, m, k in log]
    df = spark.createDataFrame(rows, "op_type string, s long, seq long, duration_ms double, ok boolean").selectExpr("op_type", "timestamp_seconds(s) ts", "seq", "duration_ms", "ok")
    rows = enrich.breaker(df, EnrichConfig(cooldown_seconds=60.0)).orderBy("seq").collect()
    assert [(r.allowed, r.state) for r in rows] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "closed"), (True, "closed")]


def test_top_results_are_used_again(spark):
    states, cache = model.part_states(spark, SF), topn.TopCache()
    a = cache.get(states, 5, "v1")
    assert cache.get(states, 5, "v1") is a and cache.get(states, 6, "v1") is not a and cache.get(states, 6, "v2").count() > 0
    assert (cache.hits, cache.misses) == (1, 3)
    assert plan(topn.keep_top(model.process_points(spark, SF), states, TopNConfig(n=5))).count("FileScan parquet") <= 3


def test_host_processes(spark, tmp_path):
    spark.dataSource.register(host.HostProcesses)
    rows = spark.read.format("quern_host").load().collect()
    assert any(r.memory_bytes > 0 and r.name for r in rows) and len({r.pid for r in rows}) == len(rows)


def test_reporter():
    now, sent = [0.0], []
    r = telemetry.Reporter(sent.append, capacity=3, batch=2, every=10.0, clock=lambda: now[0])
    r.put(1)
    assert not sent
    r.put(2)
    assert sent == [[1, 2]]
    now[0] = 20.0
    r.put(3)
    assert sent[-1] == [3] and r.sent == 3 and r.dropped == 0


def test_configs():
    for bad in (lambda: ReservoirConfig(k=0), lambda: TopNConfig(n=0), lambda: TopNConfig(cpu_threshold=2), lambda: EnrichConfig(fetch=("x",)), lambda: ControllerConfig(exporters=()), lambda: ControllerConfig(exporters=("a",), low=0.9, high=0.8), lambda: HeadConfig(mode="record_id"), lambda: RecordField("")):
        with pytest.raises(ValueError):
            bad()
    assert EnrichConfig(enabled=False, fetch=("x",)).fetch == ("x",)
