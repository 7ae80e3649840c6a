"""Ids to the unit interval, exactly and in generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def fold_hash(hex_id: Column) -> Column:
    """32 hex digits -> high 64 bits XOR low 64 bits as bigint; any other length -> 0."""
    half = lambda at: F.conv(F.substring(hex_id, at, 16), 16, -10).cast("bigint")
    return F.when(F.length(hex_id) == 32, half(1).bitwiseXOR(half(17))).otherwise(F.lit(0).cast("bigint"))


def unit_interval(h: Column) -> Column:
    """A 64-bit pattern, read as unsigned, over 2**64 - 1."""
    # half of a large value, its last bit kept for rounding, is a positive long
    half = F.shiftrightunsigned(h, 1).bitwiseOR(h.bitwiseAND(F.lit(1).cast("bigint")))
    value = F.when(h >= 0, h.cast("double")).otherwise(half.cast("double") * 2)
    return value / F.lit(18446744073709551615.0)


def xxhash_seed0(text: Column) -> Column:
    """xxHash64 with seed 0 of a string's UTF-8 (the SQL function's seed is 42).

    The JVM expression takes a seed; where it can't be reached, an Arrow UDF does the same."""
    jvm = SparkSession.active().sparkContext._jvm
    try:
        utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
        seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq([utils.expression(text._jc)])
        return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))
    except Exception:  # an internal class, so it may move
        return F.pandas_udf(_xxhash_series, "bigint")(text)


def _xxhash_series(s: pd.Series) -> pd.Series:
    import xxhash

    return s.map(lambda t: None if t is None else (xxhash.xxh64_intdigest(t.encode()) + 2**63) % 2**64 - 2**63)


def record_hash(record_id: Column) -> Column:
    """An id of 16 bytes is folded like a trace id, any other is hashed with seed 0."""
    short = F.octet_length(record_id) == 16
    return F.when(short, fold_hash(F.lower(F.hex(record_id.cast("binary"))))).otherwise(xxhash_seed0(record_id))


def span_key(trace_id: Column, span_id: Column) -> Column:
    return F.concat_ws("-", trace_id, span_id)
