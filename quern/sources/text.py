"""Text sources: metric exposition, process files, benchmark output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exposition(lines: DataFrame) -> DataFrame:
    """name, labels, value of the samples among lines (value); comments and others go."""
    line = F.trim("value")
    out = lines.filter(~line.startswith("#") & (line != "")).select(
        F.regexp_extract(line, r"^([A-Za-z_:][\w:]*)", 1).alias("name"),
        F.regexp_extract(line, r"^[\w:]+\{(.*)\}\s", 1).alias("raw"),
        F.expr(r"try_cast(regexp_extract(trim(value), '^[A-Za-z_:][A-Za-z0-9_:]*(?:\\{.*\\})?\\s+([^\\s]+)', 1) as double)").alias("value"),
    )
    pairs = F.regexp_extract_all("raw", F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, r'="(.*)"$', 1).alias("v")))
    return out.filter("name <> '' and value is not null").select("name", F.map_from_entries(entries).alias("labels"), "value")


def queue_samples(lines: DataFrame, ts: Column, size_name: str = "exporter_queue_size", capacity_name: str = "exporter_queue_capacity") -> DataFrame:
    """ts, exporter, queue_size, queue_capacity: sizes and capacities side by side."""
    got = exposition(lines).withColumn("exporter", F.try_element_at("labels", F.lit("exporter")))
    pick = lambda n: F.sum(F.when(F.col("name").endswith(n), F.col("value")))
    return got.groupBy("exporter").agg(pick(size_name).alias("queue_size"), pick(capacity_name).alias("queue_capacity")).filter("queue_size is not null or queue_capacity is not null").withColumn("ts", ts)


def queue_totals(lines: DataFrame, exporters: tuple[str, ...], size_name: str = "exporter_queue_size", capacity_name: str = "exporter_queue_capacity") -> DataFrame:
    """(queue_size, queue_capacity) summed over the named exporters, as one row. Where the
    parsed capacities sum to 0, lines are searched by an expression instead: it also finds
    samples inside lines that are no valid exposition."""
    parsed = queue_samples(lines, F.lit(None), size_name, capacity_name).filter(F.col("exporter").isin(*exporters))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    one = parsed.agg(total("queue_size").alias("s"), total("queue_capacity").alias("c"))
    sample = r'(\w*%s)\{exporter="([^"]*)"\} (\d+)'
    found = []
    for name in (size_name, capacity_name):
        hits = F.explode(F.regexp_extract_all("value", F.lit("(" + sample.replace("%s", name) + ")"), 1)).alias("hit")
        hits = lines.select(hits).select(F.regexp_extract("hit", r'exporter="([^"]*)"', 1).alias("exporter"), F.regexp_extract("hit", r"(\d+)$", 1).cast("double").alias("v"))
        found.append(hits.filter(F.col("exporter").isin(*exporters)).agg(total("v").alias("v")))
    both = found[0].select(F.lit(1).alias("k"), F.col("v").alias("fs")).join(found[1].select(F.lit(1).alias("k"), F.col("v").alias("fc")), "k").join(one.withColumn("k", F.lit(1)), "k")  # three rows of one
    use = F.col("c") != 0
    return both.select(F.when(use, F.col("s")).otherwise(F.col("fs")).alias("queue_size"), F.when(use, F.col("c")).otherwise(F.col("fc")).alias("queue_capacity"))


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    return exposition(spark.read.text(path))


def command_line(raw: Column) -> Column:
    """Arguments ended by NUL, as one line."""
    return F.regexp_replace(F.translate(raw, "\0", " "), r"^\s+|\s+$", "")


def status_uid(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^Uid:\s+(\S+)", 1), F.lit(""))


def io_bytes(text: Column, name: str) -> Column:
    """read_bytes or write_bytes; 0 where absent."""
    got = F.regexp_extract(text, rf"(?m)^{name}:\s*(\S+)", 1)
    return F.coalesce(got.try_cast("double"), F.lit(0.0))


def benchmark_lines(lines: DataFrame) -> DataFrame:
    """name, runs, ns_per_op, bytes_per_op, allocs_per_op from benchmark output lines."""
    line = F.col("value")
    grab = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    return lines.filter(line.rlike(r"^Benchmark\S+\s+\d+\s+[\d.]+ ns/op")).select(
        grab(r"^Benchmark(\S+?)(?:-\d+)?\s").alias("name"), grab(r"^\S+\s+(\d+)").cast("long").alias("runs"), grab(r"([\d.]+) ns/op").cast("double").alias("ns_per_op"), grab(r"(\d+) B/op").cast("long").alias("bytes_per_op"), grab(r"(\d+) allocs/op").cast("long").alias("allocs_per_op")
    )
