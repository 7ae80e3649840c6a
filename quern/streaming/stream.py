"""Streaming forms: trace sessions, stateful trace buffer, reservoir and process states, control
loop, tenant routing."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import ControllerConfig, parse_duration
from quern.operators.controller import fold
from quern.operators.reservoir import SHARDS, keyed
from quern.operators.traces import is_root
from quern.operators.transform import tenant
from quern.tunables import TunableRegistry

def trace_sessions(spans: DataFrame, timeout: str, lateness: str) -> DataFrame:
    """Traces closed by inactivity in event time; append mode emits each once."""
    grouped = spans.withWatermark("ts", lateness).groupBy("trace_id", F.session_window("ts", timeout).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_spans"), F.bool_or(is_root()).alias("has_root"))


def trace_buffer(spans: DataFrame, timeout_ms: int, close_on_root: bool = True) -> DataFrame:
    """Traces closed when their root arrives, or after inactivity in processing time: trace_id,
    n_spans, has_root, closed_by (root or timeout) and the spans themselves, in order of ts.

    Spans that come after the root start a new buffer, within one batch too, and time out as a
    unit of their own. A trace's buffered spans are its state, kept in the checkpointed store."""
    kind = spans.schema.simpleString()
    names = spans.columns
    out = f"trace_id string, n_spans long, has_root boolean, closed_by string, spans array<{kind}>"

    def step(key, frames, state):
        held = pickle.loads(state.get[0]) if state.exists else []
        closed = []

        def close(by):
            closed.append((key[0], len(held), any(h[1] for h in held), by, [dict(zip(names, h[0], strict=True)) for h in held]))
            held.clear()

        if state.hasTimedOut:
            close("timeout")
        else:
            rows = pd.concat(list(frames)).sort_values("buffer_ts", kind="stable")
            for root, *row in rows[["buffer_root", *names]].itertuples(index=False, name=None):
                held.append(([x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row], bool(root)))
                if root and close_on_root:
                    close("root")
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        for c in closed:
            yield pd.DataFrame([c], columns=["trace_id", "n_spans", "has_root", "closed_by", "spans"])

    rows = spans.withColumn("buffer_root", is_root()).withColumn("buffer_ts", F.col("ts"))
    return rows.groupBy("trace_id").applyInPandasWithState(step, out, "held binary", "append", "ProcessingTimeTimeout")


def stream_reservoir(rows: DataFrame, k: int, window: str, ident: str, lateness: str, seed: str = "reservoir", shards: int = SHARDS) -> DataFrame:
    """window_start, shard, seen and the rows of smallest draw, at most k, of every shard of
    every window, emitted once when the watermark has passed its end (``flush``); a window
    without rows emits nothing. ``merge_reservoir`` makes k of a window of them.

    State is at most k rows a shard and their count, in the checkpointed store: a restart goes
    on with the windows that were open."""
    names = rows.columns
    kind = rows.schema.simpleString()
    out = f"window_start timestamp, shard int, seen long, place_draw array<string>, kept array<{kind}>"

    def step(key, frames, state):
        seen, held = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, [])
        if state.hasTimedOut:
            state.remove()
            kept = [dict(zip(names, h[1], strict=True)) for h in held]
            yield pd.DataFrame([(key[0], key[1], seen, [h[0] for h in held], kept)], columns=["window_start", "shard", "seen", "place_draw", "kept"])
            return
        for pdf in frames:
            seen += len(pdf)
            if len(held) == k:  # what can't be among the k goes before it is made an object
                pdf = pdf[pdf["reservoir_draw"] <= held[-1][0]]
            new = [(d, [x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row]) for d, *row in pdf[["reservoir_draw", *names]].itertuples(index=False, name=None)]
            held = heapq.nsmallest(k, held + new, key=lambda h: h[0])
        state.update((seen, pickle.dumps(held)))
        state.setTimeoutTimestamp(int((key[0] + length).timestamp() * 1000))

    length = pd.Timedelta(parse_duration(window) if window[-1].isalpha() and " " not in window else window)
    draw = F.concat(keyed(F.col(ident), seed), F.col(ident))
    span = f"{int(length.total_seconds() * 1e6)} microseconds"
    marked = rows.withColumn("reservoir_ts", F.col("ts")).withWatermark("reservoir_ts", lateness)
    marked = marked.withColumn("reservoir_window", F.window("reservoir_ts", span)["start"]).withColumn("reservoir_draw", draw)
    shard = F.pmod(F.xxhash64("reservoir_draw"), F.lit(shards)).cast("int")
    grouped = marked.withColumn("reservoir_shard", shard).groupBy("reservoir_window", "reservoir_shard")
    return grouped.applyInPandasWithState(step, out, "seen long, held binary", "append", "EventTimeTimeout")


def merge_reservoir(parts: DataFrame, k: int) -> DataFrame:
    """The k rows of each window, with window_start and ``window_seen``, from emitted shards."""
    from pyspark.sql import Window

    w = Window.partitionBy("window_start")
    rows = parts.select("window_start", "seen", F.posexplode("kept").alias("at", "row"), "place_draw")
    rows = rows.withColumn("draw", F.element_at("place_draw", F.col("at") + 1))
    total = parts.groupBy("window_start").agg(F.sum("seen").alias("window_seen"))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("draw"))).filter(F.col("place") <= k)
    return rows.join(total, "window_start").select("window_start", "window_seen", "row.*")


def process_states(points: DataFrame, ttl_ms: int, cpu_threshold: float, memory_threshold: float) -> DataFrame:
    """Of every pid that has points (pid, name: cpu or mem, value, ts): its latest cpu and mem
    whenever they change, and ``evicted`` once neither has reached its threshold for ttl_ms of
    processing time. State is four numbers a pid."""
    out = "pid long, cpu double, mem double, last_updated timestamp, evicted boolean"

    def step(key, frames, state):
        cpu, mem, at, above = state.get if state.exists else (0.0, 0.0, 0, 0)
        now = state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for name, value, ts in pdf[["name", "value", "ts"]].itertuples(index=False, name=None):
                cpu, mem = (value, mem) if name == "cpu" else (cpu, value)
                at = max(at, ts.value // 1000)
                if cpu >= cpu_threshold or mem >= memory_threshold:
                    above = now
        idle = now - above >= ttl_ms
        yield pd.DataFrame({"pid": [key[0]], "cpu": [cpu], "mem": [mem], "last_updated": [pd.Timestamp(at, unit="us")], "evicted": [idle]})
        if idle:
            if state.exists:
                state.remove()
            return
        state.update((cpu, mem, at, above))
        state.setTimeoutDuration(max(1, above + ttl_ms - now))

    mine = points.filter(F.col("pid").isNotNull() & F.col("name").isin("cpu", "mem")).select(F.col("pid").cast("long").alias("pid"), "name", F.col("value").cast("double").alias("value"), "ts")
    return mine.groupBy("pid").applyInPandasWithState(step, out, "cpu double, mem double, at long, above long", "update", "ProcessingTimeTimeout")


def write_by_tenant(rows: DataFrame, path: str, checkpoint: str, column: str = "tenant_id"):
    """Micro-batches to one folder a tenant."""
    return rows.withColumn(column, tenant(F.col(column))).writeStream.partitionBy(column).option("checkpointLocation", checkpoint).format("parquet").start(path)


class ControlLoop:
    """foreachBatch callback: a batch of queue samples moves the target's probability, which
    the next batch of the sampled stream reads from the registry. A batch without capacity
    changes nothing.

    With ``path`` (a shared folder) every batch leaves its average, run and probability there,
    under its number: a loop that starts again goes on from the last one, and a batch that is
    run again changes nothing."""

    def __init__(self, config: ControllerConfig, registry: TunableRegistry, path: str | None = None, spark=None):
        self.config, self.registry, self.path = config, registry, path
        self.ewma, self.run, self.batch = 0.0, 0, -1
        if path and spark is not None:
            self._restore(spark)

    def _restore(self, spark) -> None:
        from quern.sources.tables import _fs

        system, p = _fs(spark, self.path)
        if not system.exists(p):
            return
        done = [s.getPath().getName() for s in system.listStatus(p)]
        done = sorted(int(n[1:]) for n in done if n.startswith("b") and system.exists(_fs(spark, f"{self.path}/{n}/_SUCCESS")[1]))
        if done:
            row = spark.read.parquet(f"{self.path}/b{done[-1]:012d}").first()
            self.ewma, self.run, self.batch = row["ewma"], row["run"], row["batch"]
            if row["p"] is not None:
                self.registry.set_value(self.config.target, "probability", row["p"])
            for old in done[:-1]:
                system.delete(_fs(spark, f"{self.path}/b{old:012d}")[1], True)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.path and number <= self.batch:
            return
        c = self.config
        row = batch.filter(F.col("exporter").isin(*c.exporters)).agg(F.sum("queue_size"), F.sum("queue_capacity")).first()
        p, known = self.registry.get_value(c.target, "probability")
        if row[1]:
            after, new, run = next(fold([row[0] / row[1]], c, self.ewma, p, self.run))
            self.ewma = after
            if known:
                self.run, p = run, new
                self.registry.set_value(c.target, "probability", p)
        if self.path:
            spark = batch.sparkSession
            state = spark.createDataFrame([(number, self.ewma, self.run, p if known else None)], "batch long, ewma double, run int, p double")
            state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/b{number:012d}")
            self.batch = number


def sample_with(registry: TunableRegistry, ident: str, sample: Callable[[DataFrame, float], DataFrame], write: Callable[[DataFrame, int], None]):
    """foreachBatch callback that samples each batch with the probability then in force."""

    def run(batch: DataFrame, number: int) -> None:
        p, known = registry.get_value(ident, "probability")
        write(sample(batch, p if known else 1.0), number)

    return run
