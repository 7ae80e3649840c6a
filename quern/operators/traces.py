"""Traces from spans: assembly, inactivity timeout, summaries and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_root() -> Column:
    return F.coalesce(F.col("parent_span_id"), F.lit("")) == ""


def assemble(spans: DataFrame, held: tuple[str, ...] = ()) -> DataFrame:
    """One row a trace: n_spans, has_root, first and last ts. Aggregates alone travel, unless
    ``held`` names columns of spans to list, in order, as ``spans``."""
    listed = [F.array_sort(F.collect_list(F.struct(*held))).alias("spans")] if held else []
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.bool_or(is_root()).alias("has_root"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *listed)


def status(traces: DataFrame, now: Column, timeout: str) -> DataFrame:
    """Adds ``status``: complete with a root, in-flight while the last span is no older than
    ``timeout`` at ``now``, timed-out after that."""
    open_ = F.col("last_ts") + F.expr(f"interval {timeout}") >= now
    return traces.withColumn("status", F.when(F.col("has_root"), "complete").when(open_, "in-flight").otherwise("timed-out"))


def evictions(spans: DataFrame, capacity: int, window: str) -> DataFrame:
    """What a store of full spans with this capacity has to let go in each window."""
    out = spans.groupBy(F.window("ts", window)["start"].alias("window_start")).agg(F.countDistinct("trace_id", "span_id").alias("held"))
    return out.withColumn("evicted", F.greatest(F.col("held") - F.lit(capacity), F.lit(0)))


def sessions(spans: DataFrame, timeout: str) -> DataFrame:
    """assemble, with a trace closed when no span came for more than ``timeout``."""
    grouped = spans.groupBy("trace_id", F.session_window("ts", timeout).alias("w"))
    out = grouped.agg(F.count(F.lit(1)).alias("n_spans"), F.bool_or(is_root()).alias("has_root"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.drop("w")


def regroup(spans: DataFrame) -> DataFrame:
    """Spans of each trace by scope and resource (a map, so its sorted entries are the key)."""
    key = F.to_json(F.array_sort(F.map_entries("resource")))
    return spans.withColumn("resource_key", key).groupBy("trace_id", "scope", "resource_key").agg(F.count(F.lit(1)).alias("n_spans"))


def expand(spans: DataFrame, chosen: DataFrame, key: str = "trace_id") -> DataFrame:
    """All spans of the chosen traces."""
    return spans.join(chosen.select(key), key, "left_semi")


def lost_keys(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Keys (trace_id, span_id) whose full span is not held any more."""
    return wanted.join(held, ["trace_id", "span_id"], "left_anti")


def summaries(spans: DataFrame) -> DataFrame:
    """The eleven fields that a checkpoint keeps of a span."""
    parent = F.nullif(F.col("parent_span_id"), F.lit(""))
    return spans.select("trace_id", "span_id", parent.alias("parent_span_id"), "name", "kind", "start_ns", "end_ns", "status_code", "status_message", F.try_element_at("resource", F.lit("service.name")).alias("service_name"), F.try_element_at("resource", F.lit("tenant.id")).alias("tenant_id"))


def from_summaries(rows: DataFrame) -> DataFrame:
    """Spans again, marked as summaries, under their (or the default) service and tenant."""
    named = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return rows.withColumn("service_name", named("service_name", "unknown_service")).withColumn("tenant_id", named("tenant_id", "default")).withColumn("attributes", F.create_map(F.lit("summary"), F.lit("true")))
