"""Greedy folds over one key's times, by jumps: each step goes to the next row that counts.

A key's times are one sorted array of numbers; the work is one binary search a kept row, not
one step a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jumps(times: np.ndarray, gap: int, strict: bool) -> np.ndarray:
    """Places of the first time, the first one ``gap`` (strict: more than gap) after it, and so on."""
    out, at = [], 0
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + gap, "right" if strict else "left"))
    return np.array(out, np.int64)


def _micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _starts(rows: DataFrame, by: str, seconds: float, strict: bool) -> DataFrame:
    """(by, at): the micros of each key's kept times."""
    gap = int(seconds * 1e6)
    kind = dict(rows.dtypes)[by]

    def run(group: pa.Table) -> pa.Table:
        at = np.sort(group.column("at").to_numpy())
        at = at[jumps(at, gap, strict)]
        key = pa.repeat(group.column(by)[0], len(at))
        return pa.table({by: key, "at": pa.array(at)})

    return rows.select(by, _micros().alias("at")).filter("at is not null").distinct().groupBy(by).applyInArrow(run, f"{by} {kind}, at long")


def throttle(rows: DataFrame, by: str, seconds: float) -> DataFrame:
    """(by, ts) of what a log emits at most once in ``seconds`` for each key: the first time,
    and then each first time that is ``seconds`` or more after the last one emitted."""
    return _starts(rows, by, seconds, False).select(by, F.timestamp_micros("at").alias("ts"))


def lazy_windows(rows: DataFrame, by: str, seconds: float) -> DataFrame:
    """by, window_start, n: windows that open with a row and close with the first row more than
    ``seconds`` later, which opens the next. Rows find their window by one sort a key."""
    from pyspark.sql import Window

    starts = _starts(rows, by, seconds, True).withColumn("start", F.col("at"))
    both = rows.select(by, _micros().alias("at"), F.lit(None).cast("long").alias("start"), F.lit(1).alias("n"))
    both = both.unionByName(starts.withColumn("n", F.lit(0)))
    w = Window.partitionBy(by).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("start", F.last("start", ignorenulls=True).over(w)).filter("n = 1 and at is not null")
    return found.groupBy(by, F.timestamp_micros("start").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
