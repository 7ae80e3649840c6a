"""Queue pressure to sampling probability: utilization, moving average, controller steps.

The steps are a fold over one controller's samples in order (one each 15 seconds), one pass
over its sorted arrays; controllers are groups of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import ControllerConfig


def utilization(samples: DataFrame, config: ControllerConfig) -> DataFrame:
    """ts, x: summed size over summed capacity of the named exporters; null without capacity."""
    mine = samples.filter(F.col("exporter").isin(*config.exporters))
    return mine.groupBy("ts").agg((F.sum("queue_size") / F.nullif(F.sum("queue_capacity"), F.lit(0.0))).alias("x"))


def fold(x: list[float], config: ControllerConfig, ewma: float, p: float, run: int):
    """(ewma, p, run) after each sample."""
    c = config
    for v in x:
        ewma = c.alpha * v + (1 - c.alpha) * ewma
        run = run + 1 if ewma > c.high else 0
        factor = 1.0
        if ewma > c.high:
            dropped = run >= c.patience
            factor, run = (c.drop, 0) if dropped else (c.down, run)
        elif ewma < c.low:
            factor = c.up
        p = max(c.min_p, min(c.max_p, p * factor))
        yield ewma, p, run


def steps(samples: DataFrame, config: ControllerConfig, start: float, by: str | None = None) -> DataFrame:
    """ts, x, ewma, p after each sample (ts, x) of each controller ``by``. Null x changes nothing."""
    keys = [by] if by else []
    kind = dict(samples.dtypes)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ts", "ascending"), ("x", "ascending")])
        after = list(fold(group.column("x").to_pylist(), config, 0.0, float(start), 0))
        more = {"ewma": pa.array([r[0] for r in after], pa.float64()), "p": pa.array([r[1] for r in after], pa.float64())}
        return pa.table({**{k: group.column(k) for k in (*keys, "ts", "x")}, **more})

    rows = samples.filter("x is not null").select(*keys, "ts", F.col("x").cast("double").alias("x"), F.lit(0).alias("fold_key"))
    schema = ", ".join([*(f"{k} {kind[k]}" for k in (*keys, "ts")), "x double, ewma double, p double"])
    return rows.groupBy(*(keys or ["fold_key"])).applyInArrow(run, schema)


def probability_at(rows: DataFrame, p: DataFrame, default: float) -> DataFrame:
    """Adds the p in force at each row's ts: the last step before it, however long ago.

    p is one row a control tick. Ticks become intervals by a window over each day and one over
    the days; rows meet them by hour, at most an hour's ticks each. The last tick holds without
    end, so it is not joined."""
    last = p.orderBy(F.col("ts").desc()).limit(1).collect()  # one row
    if not last:
        return rows.withColumn("p", F.lit(float(default)))
    ticks = p.select(F.col("ts").alias("p_from"), F.col("p").alias("p_then")).withColumn("p_day", F.to_date("p_from"))
    days = ticks.groupBy("p_day").agg(F.min("p_from").alias("p_first"))
    days = days.select("p_day", F.lead("p_first").over(Window.orderBy("p_day")).alias("p_next_day"))  # a row a day
    inside = F.lead("p_from").over(Window.partitionBy("p_day").orderBy("p_from"))
    spans = ticks.withColumn("p_to", inside).join(days, "p_day").withColumn("p_to", F.coalesce("p_to", "p_next_day")).filter("p_to is not null")
    hour = lambda c: F.date_trunc("hour", c).cast(dict(p.dtypes)["ts"])
    spans = spans.withColumn("p_hour", F.explode(F.sequence(hour("p_from"), hour("p_to"), F.expr("interval 1 hour")))).drop("p_day", "p_next_day")
    here = F.col("ts").cast(dict(p.dtypes)["ts"])
    hit = (F.col("p_row_hour") == F.col("p_hour")) & (here >= F.col("p_from")) & (here < F.col("p_to"))
    out = rows.withColumn("p_row_hour", hour(here)).join(spans, hit, "left")
    at_last = here >= F.lit(last[0]["ts"])
    out = out.withColumn("p", F.when(at_last, F.lit(float(last[0]["p"]))).otherwise(F.coalesce("p_then", F.lit(float(default)))))
    return out.drop("p_row_hour", "p_from", "p_to", "p_hour", "p_then")
