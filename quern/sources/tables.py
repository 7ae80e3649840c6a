"""Batch and streaming reads and writes of telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.traces import summaries
from quern.operators.transform import tenant


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """New Parquet files as they come, at most so many a batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"


def _flat(c):
    entry = lambda a: F.struct(a["key"], F.coalesce(*(a["value"][k].cast("string") for k in ("stringValue", "intValue", "doubleValue", "boolValue"))))
    return F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(_ATTRIBUTES)), entry))


def _exploded(lines: DataFrame, kind: str, record: str, items: str) -> DataFrame:
    """resource, scope and each item x of JSON lines (value) of resource<kind>s."""
    schema = f"resource{kind} array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scope{kind}:array<struct<scope:struct<name:string,version:string>,{items}:array<{record}>>>>>"
    rows = lines.select(F.from_json("value", schema).alias("j")).select(F.explode(f"j.resource{kind}").alias("r"))
    rows = rows.select(_flat(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.scope{kind}").alias("s"))
    return rows.select("resource", F.col("s.scope").alias("scope"), F.explode(f"s.{items}").alias("x"))


def _time(column: str):
    return F.timestamp_micros((F.col(column).cast("long") / 1000).cast("long"))


def otlp_logs(lines: DataFrame) -> DataFrame:
    """Log records from OTLP-JSON lines (value)."""
    record = f"struct<timeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string>,attributes:{_ATTRIBUTES}>"
    rows = _exploded(lines, "Logs", record, "logRecords")
    return rows.select(_time("x.timeUnixNano").alias("ts"), F.col("x.timeUnixNano").cast("long").alias("ts_ns"), F.col("x.severityNumber").alias("severity_number"), F.col("x.severityText").alias("severity_text"), F.col("x.body.stringValue").alias("body"), "resource", _flat(F.col("x.attributes")).alias("attributes"))


def otlp_metrics(lines: DataFrame) -> DataFrame:
    """Gauge and sum datapoints from OTLP-JSON lines (value)."""
    point = f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTRIBUTES}>"
    record = f"struct<name:string,gauge:struct<dataPoints:array<{point}>>,sum:struct<dataPoints:array<{point}>>>"
    rows = _exploded(lines, "Metrics", record, "metrics")
    kind = F.when(F.col("x.gauge").isNotNull(), "gauge").when(F.col("x.sum").isNotNull(), "sum")
    points = F.explode(F.coalesce("x.gauge.dataPoints", "x.sum.dataPoints")).alias("d")
    rows = rows.select("resource", "scope", F.col("x.name").alias("name"), kind.alias("type"), points)
    return rows.select(_time("d.timeUnixNano").alias("ts"), "resource", "scope", "name", "type", F.coalesce("d.asDouble", F.col("d.asInt").cast("double")).alias("value"), _flat(F.col("d.attributes")).alias("labels"))


def otlp_spans(spark: SparkSession, path: str) -> DataFrame:
    """Flat spans of the OTLP-JSON lines of a file or folder."""
    return parse_spans(spark.read.text(path))


def parse_spans(lines: DataFrame) -> DataFrame:
    """Flat spans from OTLP-JSON lines (value: resourceSpans, scopeSpans, spans)."""
    record = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int,message:string>>"
    rows = _exploded(lines, "Spans", record, "spans")
    ns = F.col("x.startTimeUnixNano").cast("long")
    return rows.select(F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.lower("x.parentSpanId").alias("parent_span_id"), "x.name", "x.kind", ns.alias("start_ns"), F.col("x.endTimeUnixNano").cast("long").alias("end_ns"), F.timestamp_micros((ns / 1000).cast("long")).alias("ts"), F.col("x.status.code").alias("status_code"), F.col("x.status.message").alias("status_message"), "resource", "scope", _flat(F.col("x.attributes")).alias("attributes"))


def write_by_tenant(rows: DataFrame, path: str, column: str = "tenant_id", default: str = "default") -> None:
    rows.withColumn(column, tenant(F.col(column), default)).write.mode("append").partitionBy(column).parquet(path)


def write_checkpoint(spans: DataFrame, seen: int, window_start: int, path: str) -> None:
    """The reservoir's summaries, then its counters, under a new version of path; a reader sees
    the last version whose counters are whole. Without spans n and t0 are kept all the same."""
    spark = spans.sparkSession
    version = f"{path}/v{_versions(spark, path)[-1] + 1 if _versions(spark, path) else 0:012d}"
    summaries(spans).write.mode("overwrite").parquet(f"{version}/summaries")
    spark.createDataFrame([(seen, window_start)], "total_seen long, window_start_ns long").coalesce(1).write.mode("overwrite").parquet(f"{version}/state")


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int, int] | None:
    """(summaries, n, t0) of the last whole version; None where there is none: a fresh start."""
    known = _versions(spark, path)
    if not known:
        return None
    version = f"{path}/v{known[-1]:012d}"
    row = spark.read.parquet(f"{version}/state").first()
    return spark.read.parquet(f"{version}/summaries"), row["total_seen"], row["window_start_ns"]


def compact_checkpoint(spark: SparkSession, path: str, target_bytes: int) -> bool:
    """Where path holds more than target_bytes: writes the last version again, as few files as
    its bytes need, and then deletes those before it. Until then it needs its space twice."""
    known = _versions(spark, path)
    if not known or _bytes(spark, path) <= target_bytes:
        return False
    rows, seen, start = read_checkpoint(spark, path)
    files = max(1, -(-_bytes(spark, f"{path}/v{known[-1]:012d}/summaries") // (128 << 20)))
    version = f"{path}/v{known[-1] + 1:012d}"
    rows.coalesce(files).write.parquet(f"{version}/summaries")
    spark.createDataFrame([(seen, start)], "total_seen long, window_start_ns long").coalesce(1).write.parquet(f"{version}/state")
    for v in known:
        _fs(spark, path)[0].delete(_fs(spark, f"{path}/v{v:012d}")[1], True)
    return True


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _bytes(spark: SparkSession, path: str) -> int:
    system, p = _fs(spark, path)
    return system.getContentSummary(p).getLength()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose counters are whole, in order."""
    system, p = _fs(spark, path)
    if not system.exists(p):
        return []
    names = [s.getPath().getName() for s in system.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and system.exists(_fs(spark, f"{path}/{n}/state/_SUCCESS")[1]))
