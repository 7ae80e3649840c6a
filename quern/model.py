"""The telemetry model, and the provided tables seen as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_ns long, end_ns long, ts timestamp, status_code int, status_message string, resource map<string,string>, scope struct<name:string,version:string>, attributes map<string,string>"
LOGS = "ts timestamp, ts_ns long, severity_number int, severity_text string, body string, resource map<string,string>, attributes map<string,string>"
METRIC_POINTS = "ts timestamp, resource map<string,string>, scope struct<name:string,version:string>, name string, type string, value double, labels map<string,string>"
QUEUE_SAMPLES = "ts timestamp, exporter string, queue_size double, queue_capacity double"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a trace, a turn a span, turn 0 its root; turns are 5 seconds apart."""
    c = _table(spark, sf_dir, "conversations")
    second = 1_704_067_200 + F.col("conv_id") * 20 + F.col("turn") * 5
    span = lambda turn: F.substring(F.md5(F.concat_ws(":", "conv_id", turn)), 1, 16)
    resource = F.create_map(F.lit("service.name"), F.concat(F.lit("service-"), (F.col("conv_id") % 3).cast("string")))
    resource = F.when(F.col("conv_id") % 2 == 0, F.map_concat(resource, F.create_map(F.lit("tenant.id"), F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string"))))).otherwise(resource)
    return c.select(
        F.md5(F.col("conv_id").cast("string")).alias("trace_id"), span(F.col("turn")).alias("span_id"), F.when(F.col("turn") > 0, span(F.lit(0))).otherwise("").alias("parent_span_id"),
        F.col("role").alias("name"), F.lit("internal").alias("kind"), (second * 1_000_000_000).alias("start_ns"), (second * 1_000_000_000 + F.length("text") * 1_000_000).alias("end_ns"), F.timestamp_seconds(second).alias("ts"),
        F.when(F.length("text") > 200, 2).otherwise(1).alias("status_code"), F.lit(None).cast("string").alias("status_message"), resource.alias("resource"),
        F.struct(F.col("role").alias("name"), F.lit("1").alias("version")).alias("scope"), F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("attributes"),
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a trace, a line a span, line 1 its root."""
    li = _table(spark, sf_dir, "lineitem")
    trace = F.md5(F.col("l_orderkey").cast("string"))
    return li.select(trace.alias("trace_id"), F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")), 1, 16).alias("span_id"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.substring(trace, 1, 16)).alias("parent_span_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records; the id is 16 bytes of the event's MD5."""
    e = _table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).otherwise(9)
    return e.select(
        "event_id", "ts", level.alias("severity_number"), F.concat_ws(" ", "event_type", F.lit("user"), "user_id").alias("body"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))).alias("resource"),
        F.create_map(F.lit("log.level"), "event_type", F.lit("props"), "props", F.lit("bucket"), (F.col("user_id") % 7).cast("string")).alias("attributes"), F.col("value"), F.col("event_type"),
    )


def process_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gauges of processes: pid is the user, clicks are cpu, views memory, others a host's."""
    e = _table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "mem").otherwise("host")
    return e.select(F.when(name != "host", F.col("user_id")).alias("pid"), name.alias("name"), "value", "ts", F.col("event_id").alias("seq"))


def part_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as processes: retail price is cpu, size is memory."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("cpu"), F.col("p_size").cast("double").alias("mem"))


def queue_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue samples by day and event type: summed value over a capacity of 100 an event."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("exporter")).agg(F.sum(F.floor("value")).cast("double").alias("queue_size"), (F.count(F.lit(1)) * 100.0).alias("queue_capacity"))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: the value is their time in ms, errors fail."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("op_type"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))
