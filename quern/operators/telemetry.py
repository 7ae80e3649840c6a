"""Self-telemetry: counters, ratios, rates, quantiles, and the datapoint table."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rejected(kept: Column) -> Column:
    return F.count(F.lit(1)) - F.count_if(kept)


def throughput(rows: DataFrame, seconds: int = 10) -> DataFrame:
    w = F.window("ts", f"{seconds} seconds")["start"]
    return rows.groupBy(w.alias("window_start")).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("rate"))


def hit_ratio(hit: Column) -> Column:
    return F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0))


def top_ratio(n: int, configured: int) -> float:
    return n / configured


def rate(points: DataFrame, window: str, seconds: float, *by: str) -> DataFrame:
    """Increase of a counter (value) within each window, per second."""
    return points.groupBy(*by, F.window("ts", window)["start"].alias("window_start")).agg(((F.max("value") - F.min("value")) / F.lit(seconds)).alias("rate"))


def histogram_quantile(values: DataFrame, q: float, bounds: list[float], *by: str) -> DataFrame:
    """Quantile of ``value`` by linear interpolation within cumulative buckets."""
    counts = values.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rank, out = F.lit(q) * F.col("total"), F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.lit(low) + F.lit(bounds[i] - low) * (rank - before) / F.nullif(F.col(f"b{i}") - before, F.lit(0))
        out = F.when(F.col(f"b{i}") >= rank, F.coalesce(inside, F.lit(low))).otherwise(out)
    return counts.select(*by, out.alias("quantile"))


def cumulative(points: DataFrame, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Counter datapoints hold deltas; their running sum by ts, then by ``then``.

    Sums run within a day; the sums of earlier days, a row a day, come on top. So a busy
    counter is as many tasks as it has days."""
    day = points.withColumn("cumulative_day", F.to_date("ts"))
    keys = [*by, "cumulative_day"]
    days = day.groupBy(*keys).agg(F.sum("value").alias("cumulative_of_day"))
    earlier = Window.partitionBy(*by).orderBy("cumulative_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("cumulative_before", F.coalesce(F.sum("cumulative_of_day").over(earlier), F.lit(0))).drop("cumulative_of_day")
    inside = Window.partitionBy(*keys).orderBy("ts", *then).rowsBetween(Window.unboundedPreceding, 0)
    out = day.withColumn("cumulative_in_day", F.sum("value").over(inside)).join(days, keys)
    return out.withColumn("total", F.col("cumulative_before") + F.col("cumulative_in_day")).select(*points.columns, "total")


def benchmark_summary(rows: DataFrame, by: str) -> DataFrame:
    """Extremes with their names, mean, median and count of ns_per_op."""
    v = F.col("ns_per_op")
    return rows.groupBy(by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.median(v).alias("middle"), F.min_by("name", F.struct(v, "name")).alias("fastest"), F.max_by("name", F.struct(v, "name")).alias("slowest"), F.count_distinct("name").alias("n"))


#: Kind, unit and meaning of the metrics we report.
CATALOGUE = {
    "quern.head.probability": ("gauge", "1", "sampling probability in force"),
    "quern.head.received": ("counter", "{record}", "records seen"),
    "quern.head.rejected": ("counter", "{record}", "records not kept"),
    "quern.reservoir.seen": ("counter", "{trace}", "traces of the window"),
    "quern.reservoir.incomplete_traces": ("gauge", "{trace}", "traces without a root"),
    "quern.topn.ratio": ("gauge", "1", "kept over configured N"),
    "quern.enrich.cache_hit_ratio": ("gauge", "1", "lookups answered by the cache"),
    "quern.enrich.duration": ("histogram", "ms", "time of lookups"),
    "quern.controller.utilization": ("gauge", "1", "smoothed queue utilization"),
    "quern.head.throughput": ("gauge", "{record}/s", "records a second"),
    "quern.reservoir.kept": ("gauge", "{trace}", "traces held for the window"),
    "quern.reservoir.evicted": ("counter", "{span}", "full spans let go"),
    "quern.reservoir.lost_spans": ("counter", "{span}", "kept keys without a full span"),
    "quern.reservoir.checkpoint_age": ("gauge", "s", "time since the last checkpoint"),
    "quern.topn.kept": ("gauge", "{process}", "processes kept"),
    "quern.topn.filtered": ("counter", "{record}", "records of other processes"),
    "quern.topn.evicted": ("counter", "{process}", "idle processes let go"),
    "quern.topn.cache_hits": ("counter", "1", "top-N results used again"),
    "quern.enrich.missing": ("counter", "{attribute}", "attributes that were absent"),
    "quern.enrich.errors": ("counter", "1", "failed lookups"),
    "quern.enrich.breaker_open": ("counter", "1", "lookups not tried"),
    "quern.controller.ewma": ("gauge", "1", "moving average in force"),
    "quern.controller.drops": ("counter", "1", "aggressive cuts"),
}
SCHEMA = "ts timestamp, name string, kind string, unit string, value double, labels map<string,string>"


@dataclass
class _Definition:
    kind: str
    unit: str
    description: str


class Reporter:
    """Datapoints on their way out: at most ``capacity`` wait, more are dropped and counted; a
    batch goes when ``batch`` wait or ``every`` seconds have passed since the last one. After
    ``errors`` failures in a row nothing goes for ``cooldown`` seconds; the next success closes
    the breaker."""

    def __init__(self, send: Callable[[list], None], *, capacity: int = 1000, batch: int = 10, every: float = 0.1, errors: int = 5, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.send, self.capacity, self.batch, self.every, self.errors, self.cooldown, self.clock = send, capacity, batch, every, errors, cooldown, clock
        self.waiting: deque = deque()
        self.sent = self.dropped = self.failed = 0
        self._last, self._until = clock(), float("-inf")

    @property
    def is_open(self) -> bool:
        return self.clock() < self._until

    def put(self, point) -> bool:
        if len(self.waiting) >= self.capacity:
            self.dropped += 1
            return False
        self.waiting.append(point)
        if len(self.waiting) >= self.batch or self.clock() - self._last >= self.every:
            self.flush()
        return True

    def flush(self) -> bool:
        """Sends what waits, but for an open breaker. A failed batch waits on."""
        if not self.waiting or self.is_open:
            return False
        self._last = self.clock()
        batch = list(self.waiting)
        try:
            self.send(batch)
        except Exception:
            self.failed += 1
            if self.failed >= self.errors:
                self._until = self.clock() + self.cooldown
            return False
        for _ in batch:
            self.waiting.popleft()
        self.sent, self.failed = self.sent + len(batch), 0
        return True


class MetricRegistry:
    """Definitions by name and datapoints on the driver, the last ``most`` of them; a reporter
    gets each one too."""

    def __init__(self, reporter: Reporter | None = None, most: int = 100_000):
        self.reporter = reporter
        self._known: dict[str, _Definition] = {k: _Definition(*v) for k, v in CATALOGUE.items()}
        self._points: deque[tuple] = deque(maxlen=most)
        self.unknown = 0

    def define(self, name: str, kind: str, unit: str = "1", description: str = "") -> None:
        self._known.setdefault(name, _Definition(kind, unit, description))

    def update(self, name: str, value: float, labels: dict[str, str] | None = None, ts: datetime | None = None) -> bool:
        """Appends a datapoint; an unknown name is counted and otherwise ignored."""
        if (d := self._known.get(name)) is None:
            self.unknown += 1
            return False
        self._points.append((ts or datetime.now(UTC), name, d.kind, d.unit, float(value), labels or {}))
        if self.reporter is not None:
            self.reporter.put(self._points[-1])
        return True

    def snapshot(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self._points), SCHEMA)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(name, d.kind, d.unit, d.description) for name, d in self._known.items()]
        return spark.createDataFrame(rows, "name string, kind string, unit string, description string")
