"""Uniform k-of-n samples per window.

The k rows with the smallest keyed hash of a window are a uniform k-subset, the same on every
run and mergeable: of every window each of SHARDS parts keeps its k best, and only those meet.
So a window with most of the rows is many tasks, whatever k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SHARDS = 32


def keyed(ident, seed: str):
    return F.md5(F.concat(ident, F.lit(seed)))


def reservoir(rows: DataFrame, k: int, window: str, ident: str, ts: str = "ts", seed: str = "reservoir") -> DataFrame:
    """Up to k rows of every window of event time, as they are."""
    w = F.window(F.col(ts), window)["start"]
    ranked = rows.withColumn("window_start", w).withColumn("draw", keyed(F.col(ident), seed))
    ranked = ranked.withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(SHARDS)))
    best = lambda *by: F.row_number().over(Window.partitionBy("window_start", *by).orderBy("draw", ident))
    some = ranked.withColumn("place", best("shard")).filter(F.col("place") <= k)
    return some.withColumn("place", best()).filter(F.col("place") <= k).drop("draw", "place", "shard")


def trace_reservoir(spans: DataFrame, k: int, window: str, seed: str = "reservoir") -> DataFrame:
    """All spans of up to k traces of every window; a trace belongs to its first span's."""
    traces = spans.groupBy("trace_id").agg(F.min("ts").alias("ts"))
    return spans.join(reservoir(traces, k, window, "trace_id", "ts", seed).select("trace_id", "window_start"), "trace_id")


def window_stats(rows: DataFrame, k: int, window: str, ident: str, ts: str = "ts") -> DataFrame:
    """Seen, kept and dropped of each window."""
    out = rows.groupBy(F.window(F.col(ts), window)["start"].alias("window_start")).agg(F.countDistinct(ident).alias("seen"))
    return out.withColumn("kept", F.least(F.col("seen"), F.lit(k).cast("long"))).withColumn("dropped", F.col("seen") - F.col("kept"))
