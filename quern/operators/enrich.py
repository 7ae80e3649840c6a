"""Attributes of processes from lookup tables, the completeness gate, cache and breaker."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import EnrichConfig


def executable_name(name: Column, path: Column) -> Column:
    """The name, or the last segment of the path."""
    return F.coalesce(name, F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")))


def missing(columns: dict[str, Column]) -> Column:
    """Names of the absent attributes (an empty one is present)."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in columns.items()]))


def gate(rows: DataFrame, missing_column: str, pid: str, strict: bool) -> DataFrame:
    """In strict mode rows of processes that lack two or more attributes go."""
    return rows.filter(F.col(pid).isNull() | (F.size(missing_column) < 2)) if strict else rows


def enrich(rows: DataFrame, config: EnrichConfig, *, cmdline: DataFrame | None = None, status: DataFrame | None = None, passwd: DataFrame | None = None, exe: DataFrame | None = None, io: DataFrame | None = None) -> DataFrame:
    """Fills absent attributes of rows (pid, cmdline, owner, exe_path, exe_name, io columns)
    from one row a pid of each lookup; what is there stays. Spark broadcasts small lookups."""
    pid = F.expr("try_cast(pid as int)")
    out = rows.withColumn("_pid", pid)
    if cmdline is not None and "command_line" in config.fetch:
        out = out.join(cmdline.select(F.col("pid").alias("_pid"), F.col("cmdline").alias("_c")), "_pid", "left").withColumn("cmdline", F.coalesce("cmdline", F.nullif(F.col("_c"), F.lit("")))).drop("_c")
    if status is not None and passwd is not None and "owner" in config.fetch:
        users = status.join(passwd, "uid", "left").select(F.col("pid").alias("_pid"), owner_name(F.col("uid"), F.col("username")).alias("_o"))
        out = out.join(users, "_pid", "left").withColumn("owner", F.coalesce("owner", "_o")).drop("_o")
    if exe is not None and "executable_path" in config.fetch:
        out = out.join(exe.select(F.col("pid").alias("_pid"), F.col("path").alias("_p")), "_pid", "left").withColumn("exe_path", F.coalesce("exe_path", F.nullif(F.col("_p"), F.lit("")))).drop("_p")
        out = out.withColumn("exe_name", executable_name(F.col("exe_name"), F.col("exe_path")))
    if io is not None and "io" in config.fetch:
        out = out.join(io.select(F.col("pid").alias("_pid"), F.col("read_bytes").alias("_r"), F.col("write_bytes").alias("_w")), "_pid", "left")
        out = out.withColumn("read_bytes", F.coalesce("read_bytes", "_r")).withColumn("write_bytes", F.coalesce("write_bytes", "_w")).drop("_r", "_w")
    return out.drop("_pid")


#: The lookup that supplies each attribute, and its column here.
SUPPLIES = {
    "process.command_line": ("command_line", "cmdline"),
    "process.owner": ("owner", "owner"),
    "process.executable.path": ("executable_path", "exe_path"),
    "process.executable.name": ("executable_path", "exe_name"),
    "process.disk.io.read_bytes": ("io", "read_bytes"),
    "process.disk.io.write_bytes": ("io", "write_bytes"),
}


def any_missing(config: EnrichConfig) -> Column:
    """Whether a row lacks one of the attributes that an enabled lookup supplies."""
    wanted = [column for lookup, column in SUPPLIES.values() if lookup in config.fetch]
    return F.greatest(F.lit(False), F.lit(False), *[F.col(c).isNull() for c in wanted])


def enrich_any(rows: DataFrame, config: EnrichConfig, **lookups: DataFrame) -> DataFrame:
    """enrich for processes that lack any attribute an enabled lookup supplies (others go by as
    they are), with ``warned``: whether a critical one is absent even then."""
    marked = rows.withColumn("enrich_needed", any_missing(config) & F.col("pid").isNotNull())
    done = enrich(marked.filter("enrich_needed"), config, **lookups)
    out = done.unionByName(marked.filter("not enrich_needed")).drop("enrich_needed")
    absent = [F.col(SUPPLIES[a][1]).isNull() for a in config.critical]
    return out.withColumn("warned", F.greatest(F.lit(False), F.lit(False), *absent) & F.col("pid").isNotNull())


def enrich_critical(rows: DataFrame, config: EnrichConfig, **lookups: DataFrame) -> DataFrame:
    """enrich with the lookups alone that supply a critical attribute, io among them, and only
    for processes in whose set of absent attributes one of those is."""
    absent = missing({a: F.col(SUPPLIES[a][1]) for a in config.critical})
    fetch = tuple({SUPPLIES[a][0] for a in config.critical} & set(config.fetch))
    marked = rows.withColumn("enrich_needed", (F.size(absent) > 0) & F.col("pid").isNotNull())
    done = enrich(marked.filter("enrich_needed"), replace(config, fetch=fetch), **lookups)
    return done.unionByName(marked.filter("not enrich_needed")).drop("enrich_needed")


def expires(loaded_at: Column, kind: Column, config: EnrichConfig) -> Column:
    """When a cache entry of this kind of attribute ends: owners and paths have TTLs of their own."""
    seconds = F.when(kind == "owner", config.owner_ttl_seconds).when(kind == "executable_path", config.path_ttl_seconds).otherwise(config.ttl_seconds)
    return loaded_at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def gates(rows: DataFrame, config: EnrichConfig, critical: dict[str, Column], pid: str = "pid", **lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gate after enrichment, and (stage, dropped, warned) of the one before and the one
    after: in strict mode two or more absent attributes drop a process, else they warn."""
    short = F.col(pid).isNotNull() & (F.size(missing(critical)) >= 2)
    done = enrich(rows, config, **lookups)
    counts = [df.agg(F.lit(stage).alias("stage"), F.count_if(short & config.strict).alias("dropped"), F.count_if(short & (not config.strict)).alias("warned")) for stage, df in (("before", rows), ("after", done))]
    return done.filter(~short) if config.strict else done, counts[0].unionByName(counts[1])


def owner_name(uid: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(username, F.lit("")), F.concat(F.lit("uid:"), uid))


def with_valid_entry(probes: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Probes (key, ts) with the cache entry (key, loaded_at, expires_at, value, has_error)
    loaded last before them and not expired: hit, value. One sort by key and time, no range
    join: a key's entries and probes meet in one window."""
    from pyspark.sql import Window

    left = probes.select(key, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.struct(*probes.columns).alias("probe"), F.lit(None).cast(cache.select(F.struct("loaded_at", "expires_at", "value", "has_error")).schema[0].dataType).alias("entry"))
    right = cache.select(key, F.col("loaded_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), F.struct("loaded_at", "expires_at", "value", "has_error").alias("entry"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("last", F.last("entry", ignorenulls=True).over(w)).filter("kind = 1")
    hit = F.coalesce(F.col("last.expires_at") > F.col("at"), F.lit(False))
    return both.select("probe.*", hit.alias("hit"), F.when(hit & ~F.col("last.has_error"), F.col("last.value")).alias("value"))


def duration_tier(ms: Column) -> Column:
    return F.when(ms < 100, "<100ms").when(ms < 500, "100-500ms").when(ms < 1000, "500ms-1s").otherwise(">1s")


def error_class(message: Column) -> Column:
    return F.coalesce(F.trim(F.substring_index(message, ":", -1)), F.lit("unknown"))


def breaker(log: DataFrame, config: EnrichConfig, variant: bool = False) -> DataFrame:
    """Operations (op_type, ts, seq, duration_ms, ok) with allowed, state and slow_count.

    An operation's fate depends on all before it of its type, so each type is one ordered
    group; types are few and their logs short. An operation is slow if it failed or took
    longer than slow_ms; slow_limit in a row open the breaker for the cooldown, which rejects
    operations; later ones are let through until a fast one closes it. variant: only failures
    count, and the breaker closes as soon as the cooldown is over."""
    slow_ms, cool, limit, again = config.slow_ms, config.cooldown_seconds, config.slow_limit, config.reopen_on_failed_probe

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
        is_open, until, count, out = False, None, 0, []
        for ts, ms, ok in zip(pdf["ts"], pdf["duration_ms"], pdf["ok"], strict=True):
            if is_open and ts < until:
                out.append((False, "open", count))
                continue
            if variant and is_open:
                is_open, count = False, 0
            if not ok or (not variant and ms > slow_ms):
                count += 1
                if count >= limit and not is_open or is_open and again:
                    is_open, until = True, ts + pd.Timedelta(seconds=cool)
            else:
                is_open, count = False, 0
            out.append((True, "open" if is_open else "closed", count))
        pdf[["allowed", "state", "slow_count"]] = pd.DataFrame(out, columns=["a", "b", "c"])
        return pdf

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    return log.groupBy("op_type").applyInPandas(run, f"{columns}, allowed boolean, state string, slow_count long")
