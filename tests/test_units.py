import time

import pytest
from pyspark.sql import functions as F

from quern.config import ControllerConfig, HeadConfig, parse_duration
from quern.functions.hashing import _xxhash_series, fold_hash, unit_interval, xxhash_seed0
from quern.operators import controller, head
from quern.plans.pipeline import Pipeline, check_order
from quern.sources.text import benchmark_lines, queue_samples
from quern.streaming.stream import ControlLoop, trace_buffer, trace_sessions
from quern.tunables import Tunable, TunableRegistry


def test_half_of_a_thousand_traces(spark):
    ids = [(bytes([i & 255, i >> 8]) + bytes(14)).hex() for i in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "trace_id string")
    assert head.sample_traces(df, HeadConfig(probability=0.5)).count() == 512
    assert head.sample_traces(df, HeadConfig(probability=0.0)).count() == 0
    assert head.sample_traces(df, HeadConfig(probability=1.0)).count() == 1000


def test_hashes(spark):
    row = spark.range(1).select(fold_hash(F.lit("000102030405060708090a0b0c0d0e0f")), unit_interval(F.lit(-1).cast("bigint")), xxhash_seed0(F.lit("abc"))).first()
    assert row[0] == 0x0808080808080808 and row[1] == 1.0 and row[2] == 0x44BC2CF5AD770999
    import pandas as pd

    assert _xxhash_series(pd.Series(["abc"]))[0] == 0x44BC2CF5AD770999


def test_controller(spark):
    c = ControllerConfig(exporters=("e",), alpha=1.0, patience=2, max_p=1.0)
    rows = spark.createDataFrame([(i, 0.9) for i in range(4)], "ts long, x double")
    assert [round(r.p, 6) for r in controller.steps(rows, c, 0.5).orderBy("ts").collect()] == [0.4, 0.2, 0.16, 0.08]
    registry = TunableRegistry()
    registry.register(Tunable(c.target, {"probability": 0.5}))
    loop = ControlLoop(c, registry)
    batch = spark.createDataFrame([("e", 9.0, 10.0)], "exporter string, queue_size double, queue_capacity double")
    got = []
    for i in range(4):
        loop(batch, i)
        got.append(round(registry.get_value(c.target, "probability")[0], 6))
    assert got == [0.4, 0.2, 0.16, 0.08]


def test_registry(spark):
    r = TunableRegistry()
    r.register(Tunable("a", {"p": 0.5}, {"p": HeadConfig(min_p=0.1, max_p=0.9).clamp}))
    assert r.set_value("a", "p", 0.05) and r.get_value("a", "p") == (0.1, True)
    assert not r.set_value("b", "p", 1) and r.get_value("b", "p") == (0.0, False) and r.get_value("a", "x") == (0.0, True)
    assert r.list(spark).count() == 1


def test_config():
    assert parse_duration("1h30m").total_seconds() == 5400 and parse_duration("500ms").total_seconds() == 0.5
    for bad in ("", "5", "x", "5 s"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    with pytest.raises(ValueError):
        HeadConfig(min_p=0.5, max_p=0.1)
    assert check_order(["pii", "head_sample", "reservoir"]) == [] and check_order(["reservoir", "head_sample"])
    with pytest.raises(ValueError):
        Pipeline([("topn", lambda d: d), ("enrich", lambda d: d), ("normalize", lambda d: d)])


def test_text_sources(spark):
    lines = ["# TYPE x gauge", 'x_exporter_queue_size{exporter="a",k="v"} 820', 'x_exporter_queue_capacity{exporter="a"} 1000', "BenchmarkTop/n=10-8   100   12.5 ns/op   8 B/op   1 allocs/op"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    row = queue_samples(df, F.lit(1)).first()
    assert (row.exporter, row.queue_size, row.queue_capacity) == ("a", 820.0, 1000.0)
    b = benchmark_lines(df).first()
    assert (b.name, b.runs, b.ns_per_op, b.bytes_per_op, b.allocs_per_op) == ("Top/n=10", 100, 12.5, 8, 1)


def test_streams(spark, tmp_path):
    spans = spark.createDataFrame([("a", "", "2024-01-01 00:00:00"), ("a", "r", "2024-01-01 00:00:01"), ("b", "r", "2024-01-01 00:00:00"), ("z", "", "2024-01-03 00:00:00")], "trace_id string, parent_span_id string, t string").selectExpr("trace_id", "parent_span_id", "cast(t as timestamp) ts")
    spans.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spans.schema).parquet(f"{tmp_path}/in")
    for name, df in (("sessions", trace_sessions(stream(), "5 seconds", "1 minute")), ("buffer", trace_buffer(stream(), 600_000))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        end = time.monotonic() + 60
        while not any(x["numInputRows"] for x in q.recentProgress) and time.monotonic() < end:
            time.sleep(0.1)
        time.sleep(4)  # the batch that the new watermark brings
        q.stop()
    assert {(r.trace_id, r.n_spans, r.has_root) for r in spark.table("sessions").collect()} >= {("a", 2, True), ("b", 1, False)}
    assert {(r.trace_id, r.n_spans, r.closed_by) for r in spark.table("buffer").collect()} == {("a", 1, "root"), ("z", 1, "root")}  # the span after a's root starts anew
