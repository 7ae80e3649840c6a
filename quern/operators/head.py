"""Id-consistent head sampling: a row's fate depends on its id and p alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import ContentFilter, CriticalPattern, HeadConfig
from quern.functions.hashing import fold_hash, record_hash, unit_interval
from quern.functions.matching import field, wildcard
from quern.functions.record_id import normalized, record_id


def sample_traces(spans: DataFrame, config: HeadConfig, p: float | None = None) -> DataFrame:
    """Spans of the traces with unit(id) < p; no exchange, and no filter at all from p = 1 on."""
    p = config.probability if p is None else p
    if p >= 1:
        return spans
    h = fold_hash(F.col("trace_id")) if config.mode == "trace_id" else record_hash(F.col("trace_id"))
    return spans.filter(unit_interval(h) < F.lit(float(p)))


def critical_level(patterns: tuple[CriticalPattern, ...], resolve) -> Column:
    """Severity level of the first pattern that matches, else null."""
    levels = [F.when(F.coalesce(wildcard(resolve(c.field), c.pattern), F.lit(False)), F.lit(c.level)) for c in patterns]
    return F.coalesce(*levels) if levels else F.lit(None).cast("int")


def content_action(filters: tuple[ContentFilter, ...], resolve) -> Column:
    """struct<action, p> of the first filter that matches, else null."""
    found = F.lit(None).cast("struct<action:string,p:double>")
    for f in reversed(filters):
        hit = F.coalesce(wildcard(resolve(f.field), f.pattern), F.lit(False))
        found = F.when(hit, F.struct(F.lit(f.action).alias("action"), F.lit(float(f.probability)).alias("p"))).otherwise(found)
    return found


def judge_logs(logs: DataFrame, config: HeadConfig, p: float | None = None, ids: Column | None = None) -> DataFrame:
    """Adds critical_level, action, record_id, kept. ids: a ready record id."""
    p = config.probability if p is None else p
    resolve = lambda name: field(name, F.col("body"), F.col("attributes"), F.col("resource"))
    if ids is None:
        row = F.sha2(F.to_json(F.struct(*[c for c in logs.columns])), 256)
        ids = record_id(normalized(weighted=config.record_fields), resolve, row)
    out = logs.withColumn("critical_level", critical_level(config.critical, resolve)).withColumn("found", content_action(config.filters, resolve)).withColumn("record_id", ids)
    u = unit_interval(record_hash(F.col("record_id")))
    keep = F.when(F.col("critical_level").isNotNull(), True).when(F.col("found.action") == "include", True).when(F.col("found.action") == "exclude", False)
    keep = keep.when(F.col("found.action") == "weighted", u < F.col("found.p")).otherwise(F.lit(True) if p >= 1 else u < F.lit(float(p)))
    return out.withColumn("action", F.col("found.action")).withColumn("kept", F.coalesce(keep, F.lit(False))).drop("found")


def effective(config: HeadConfig, registry=None) -> float:
    """The probability in force: the registry's for the config's tunable, clamped, else its own."""
    if registry is not None:
        p, known = registry.get_value(config.tunable_id, "probability")
        if known:
            return config.clamp(p)
    return config.probability


def sample_logs(logs: DataFrame, config: HeadConfig, p: float | None = None) -> DataFrame:
    if (config.probability if p is None else p) >= 1 and not config.filters:
        return logs
    return judge_logs(logs, config, p).filter("kept").select(*logs.columns)
