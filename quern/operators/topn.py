"""Top-N of entities by two measures, their latest state and idle expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import TopNConfig


def top(states: DataFrame, measure: str, n: int) -> DataFrame:
    """The n rows with the highest measure; of equal ones the lowest pid. One bounded sort."""
    return states.orderBy(F.col(measure).desc_nulls_last(), F.col("pid")).limit(n)


def top_union(states: DataFrame, n: int) -> DataFrame:
    """pids among the top n by cpu or by memory: n to 2n of them (all, if there are no more)."""
    return top(states, "cpu", n).select("pid").union(top(states, "mem", n).select("pid")).distinct()


def keep_top(rows: DataFrame, states: DataFrame, config: TopNConfig) -> DataFrame:
    """rows of the top pids, and all rows without a pid, in one scan. At most 2n pids are broadcast."""
    return judge_top(rows, states, config).filter("top_kept").select(*rows.columns)


def judge_top(rows: DataFrame, states: DataFrame, config: TopNConfig) -> DataFrame:
    """rows with ``top_kept``: whether they are of a top pid, or of none."""
    if config.max_scanned:
        states = states.orderBy("pid").limit(config.max_scanned)
    chosen = top_union(states.filter("pid is not null"), config.n).withColumn("top_kept", F.lit(True))
    return rows.join(F.broadcast(chosen), "pid", "left").withColumn("top_kept", F.col("pid").isNull() | F.coalesce("top_kept", F.lit(False)))


def latest_state(points: DataFrame) -> DataFrame:
    """pid, cpu, mem, last_updated from gauge points (pid, name, value, ts, seq): the latest
    of each name, 0 where only the other is known."""
    at = F.struct("ts", "seq")
    pick = lambda name: F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, at))
    out = points.filter(F.col("pid").isNotNull() & F.col("name").isin("cpu", "mem")).groupBy("pid").agg(pick("cpu").alias("cpu"), pick("mem").alias("mem"), F.max("ts").alias("last_updated"))
    return out.withColumn("cpu", F.coalesce("cpu", F.lit(0.0))).withColumn("mem", F.coalesce("mem", F.lit(0.0)))


def last_above(points: DataFrame, config: TopNConfig) -> DataFrame:
    """Adds the last time, so far, that cpu or memory reached its threshold (null: never)."""
    above = (F.col("cpu") >= config.cpu_threshold) | (F.col("mem") >= config.memory_threshold)
    w = Window.partitionBy("pid").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("last_above", F.max(F.when(above, F.col("ts"))).over(w))


def evict_idle(states: DataFrame, now, ttl: str) -> DataFrame:
    """States that reached a threshold within ttl before now; the never-above go at once."""
    from quern.config import parse_duration

    micros = int(parse_duration(ttl).total_seconds() * 1e6)
    idle = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_above").cast("timestamp"))
    return states.filter(F.coalesce(idle <= micros, F.lit(False)))


class TopCache:
    """The last top pids, used again until the states' version or n changes."""

    def __init__(self):
        self.hits = self.misses = 0
        self._key, self._held = None, None

    def get(self, states: DataFrame, n: int, version) -> DataFrame:
        if self._key == (version, n):
            self.hits += 1
            return self._held
        self.misses += 1
        if self._held is not None:
            self._held.unpersist()
        self._key, self._held = (version, n), top_union(states, n).persist()
        return self._held
