"""Further queries over the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import model
from quern.config import EnrichConfig, HeadConfig, RecordField, TopNConfig
from quern.functions.matching import field
from quern.functions.record_id import normalized, record_id
from quern.operators import enrich, folds, head, reservoir, telemetry, topn, traces
from quern.plans.catalog import ENRICH, ENRICHED, TOP, TOP_UNION, _lookups, _processes, _unit, _user_spans, query
from quern.sources import tables
from quern.sources import text as sources
from quern.tunables import Tunable, TunableRegistry


@query("SELECT event_id FROM events")
def log_pass_through(spark, sf_dir):
    return head.sample_logs(model.event_logs(spark, sf_dir), HeadConfig(probability=1.0)).select("event_id")


@query(f"SELECT conv_id, turn FROM conversations WHERE {_unit('hex(substr(md5(CAST(conv_id AS VARCHAR)), 1, 16))')} < 0.25")
def trace_sample_by_record(spark, sf_dir):
    """Record mode on traces: an id of 16 bytes is folded as record ids are."""
    c = model._table(spark, sf_dir, "conversations").withColumn("trace_id", F.substring(F.md5(F.col("conv_id").cast("string")), 1, 16))
    config = HeadConfig(probability=0.25, mode="record_id", record_fields=(RecordField("message"),))
    return head.sample_traces(c, config).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'flat' ELSE CAST(user_id AS VARCHAR) END AS nested, CASE WHEN event_id % 3 <> 0 THEN event_type END AS deep, NULL::VARCHAR AS none FROM events")
def dotted_path(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    inner = F.to_json(F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("more")))
    flat = F.create_map(F.lit("user.id"), F.lit("flat"), F.lit("user"), F.lit("no json"))
    e = e.withColumn("m", F.when(F.col("event_id") % 3 == 0, flat).otherwise(F.create_map(F.lit("user"), inner)))
    get = lambda name: field(name, F.lit(""), F.col("m"))
    return e.select("event_id", get("user.id").alias("nested"), get("user.more.kind").alias("deep"), get("user.more.kind.x").alias("none"))


@query("""SELECT event_id, array_to_string(list_sort([event_type || ' user ' || user_id, event_type]), ':') AS default_id,
CASE WHEN user_id % 7 = 0 THEN 'row-' || event_id ELSE (user_id % 7) || ':' || (user_id % 7) || ':' || 'none' || ':' || event_type END AS weighted_id FROM events""")
def log_record_id_config(spark, sf_dir):
    """Default fields; weight 0 read as 1; a default value; a required field and its surrogate."""
    logs = model.event_logs(spark, sf_dir)
    bucket = F.nullif(F.element_at("attributes", "bucket"), F.lit("0"))
    attributes = F.map_filter(F.map_concat("attributes", F.create_map(F.lit("need"), F.coalesce(bucket, F.lit("")))), lambda k, v: v != "")
    resolve = lambda n: field(n, F.col("body"), attributes, F.col("resource"))
    weighted = normalized(simple=("ignored",), weighted=(RecordField("need", 2.0, required=True), RecordField("absent", 0.0, default="none"), RecordField("log.level", 0.5)))
    row = F.concat(F.lit("row-"), F.col("event_id").cast("string"))
    return logs.select("event_id", record_id(normalized(), resolve, row).alias("default_id"), record_id(weighted, resolve, row).alias("weighted_id"))


def _lines(spark, sf_dir):
    p = model._table(spark, sf_dir, "part")
    size = F.format_string('x_exporter_queue_size{exporter="%s",k="a\\\\b"} %d', "p_brand", "p_size")
    capacity = F.format_string('x_exporter_queue_capacity{exporter="%s"} 100', "p_brand")
    return p.select(F.explode(F.array(size, capacity, F.lit("# HELP x y"), F.lit(""), F.concat(F.lit("plain "), F.col("p_partkey").cast("string")))).alias("value"))


@query("""SELECT name, exporter, count(*) AS n, sum(value) AS total FROM (SELECT unnest(['x_exporter_queue_size', 'x_exporter_queue_capacity', 'plain']) AS name, unnest([p_brand, p_brand, NULL]) AS exporter, unnest([p_size, 100, p_partkey])::DOUBLE AS value FROM part) GROUP BY ALL""")
def exposition_scrape(spark, sf_dir):
    got = sources.exposition(_lines(spark, sf_dir)).withColumn("exporter", F.try_element_at("labels", F.lit("exporter")))
    return got.groupBy("name", "exporter").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT p_brand AS exporter, sum(p_size)::DOUBLE AS queue_size, count(*) * 100.0::DOUBLE AS queue_capacity FROM part GROUP BY 1")
def exposition_queues(spark, sf_dir):
    return sources.queue_samples(_lines(spark, sf_dir), F.lit(0)).select("exporter", "queue_size", "queue_capacity")


@query("""SELECT 'parsed' AS how, sum(p_size)::DOUBLE AS queue_size, count(*) * 100.0::DOUBLE AS queue_capacity FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')
UNION ALL SELECT 'searched', sum(p_size)::DOUBLE, count(*) * 100.0::DOUBLE FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')""")
def exposition_fallback(spark, sf_dir):
    """Totals of two exporters, from exposition lines, and from lines that are none."""
    mine = ("Brand#11", "Brand#12")
    p = model._table(spark, sf_dir, "part")
    odd = p.select(F.format_string('> otelx_exporter_queue_size{exporter="%s"} %d; otelx_exporter_queue_capacity{exporter="%s"} 100', "p_brand", "p_size", "p_brand").alias("value"))
    out = [sources.queue_totals(lines, mine).withColumn("how", F.lit(how)) for how, lines in (("parsed", _lines(spark, sf_dir)), ("searched", odd))]
    return out[0].unionByName(out[1]).select("how", "queue_size", "queue_capacity")


def _attribute(key, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


@query("""SELECT md5(CAST(conv_id AS VARCHAR)) AS trace_id, substr(md5(conv_id || ':' || turn), 1, 16) AS span_id, role AS name, 'scope-' || role AS scope, 1000000000 * (1704067200 + turn) AS start_ns,
'svc' AS service, CAST(turn AS VARCHAR) AS turn FROM conversations""")
def otlp_spans_parsed(spark, sf_dir):
    c = model._table(spark, sf_dir, "conversations")
    start = (1_000_000_000 * (1_704_067_200 + F.col("turn"))).cast("string")
    span = F.struct(F.upper(F.md5(F.col("conv_id").cast("string"))).alias("traceId"), F.substring(F.md5(F.concat_ws(":", "conv_id", "turn")), 1, 16).alias("spanId"), F.col("role").alias("name"), start.alias("startTimeUnixNano"), start.alias("endTimeUnixNano"), F.array(_attribute("turn", F.col("turn").cast("string"))).alias("attributes"))
    scope = F.struct(F.struct(F.concat(F.lit("scope-"), F.col("role")).alias("name")).alias("scope"), F.array(span).alias("spans"))
    line = F.struct(F.array(F.struct(F.struct(F.array(_attribute("service.name", F.lit("svc"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    out = tables.parse_spans(c.select(F.to_json(line).alias("value")))
    return out.select("trace_id", "span_id", "name", F.col("scope.name").alias("scope"), "start_ns", F.element_at("resource", "service.name").alias("service"), F.element_at("attributes", "turn").alias("turn"))


@query("SELECT 1000000 * event_id AS ts_ns, CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS severity_number, event_type AS body, CAST(user_id AS VARCHAR) AS user_id FROM events")
def otlp_logs_parsed(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    record = F.struct((1_000_000 * F.col("event_id")).cast("string").alias("timeUnixNano"), F.when(F.col("event_type") == "error", 17).otherwise(9).alias("severityNumber"), F.struct(F.col("event_type").alias("stringValue")).alias("body"), F.array(_attribute("user", F.col("user_id").cast("string"))).alias("attributes"))
    line = F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    out = tables.otlp_logs(e.select(F.to_json(line).alias("value")))
    return out.select("ts_ns", "severity_number", "body", F.element_at("attributes", "user").alias("user_id"))


@query("SELECT event_type AS name, CASE WHEN event_type = 'click' THEN 'sum' ELSE 'gauge' END AS type, CAST(event_id AS VARCHAR) AS event_id, floor(value)::DOUBLE AS value FROM events")
def otlp_metrics_parsed(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    point = F.struct(F.lit("1").alias("timeUnixNano"), F.floor("value").cast("long").cast("string").alias("asInt"), F.array(_attribute("id", F.col("event_id").cast("string"))).alias("attributes"))
    points = F.struct(F.array(point).alias("dataPoints"))
    metric = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") != "click", points).alias("gauge"), F.when(F.col("event_type") == "click", points).alias("sum"))
    line = F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    out = tables.otlp_metrics(e.select(F.to_json(line).alias("value")))
    return out.select("name", "type", F.element_at("labels", "id").alias("event_id"), "value")


@query("SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id, count(*) AS n_spans, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM lineitem GROUP BY l_orderkey")
def assemble_trace_spans(spark, sf_dir):
    li = model._table(spark, sf_dir, "lineitem")
    spans = li.select(F.md5(F.col("l_orderkey").cast("string")).alias("trace_id"), F.lit("").alias("parent_span_id"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("int").alias("line"))
    out = traces.assemble(spans, held=("line",))
    return out.select("trace_id", "n_spans", F.array_join(F.transform("spans", lambda x: x["line"].cast("string")), ",").alias("lines"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN bool_or(event_type = 'signup') THEN 'complete' WHEN max(ts) + INTERVAL 6 HOUR >= TIMESTAMP '2024-01-30 00:00:00' THEN 'in-flight' ELSE 'timed-out' END AS status FROM events GROUP BY user_id) GROUP BY 1")
def trace_status(spark, sf_dir):
    got = traces.assemble(_user_spans(spark, sf_dir))
    return traces.status(got, F.lit("2024-01-30 00:00:00").cast("timestamp"), "6 hours").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS held, greatest(count(*) - 300, 0) AS evicted FROM events GROUP BY 1")
def span_evictions(spark, sf_dir):
    e = model._table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "ts")
    return traces.evictions(e, 300, "1 day")


CAPPED = "(SELECT p_partkey AS pid, p_retailprice AS cpu, p_size AS mem FROM part ORDER BY p_partkey LIMIT 60)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey AS pid FROM lineitem WHERE l_partkey IN ((SELECT pid FROM {CAPPED} ORDER BY cpu DESC, pid LIMIT 5) UNION (SELECT pid FROM {CAPPED} ORDER BY mem DESC, pid LIMIT 5))")
def topn_scan_cap(spark, sf_dir):
    rows = model._table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pid"))
    return topn.keep_top(rows, model.part_states(spark, sf_dir), TopNConfig(n=5, max_scanned=60))


@query(f"SELECT count(*) FILTER (NOT kept) AS filtered, count(DISTINCT CASE WHEN NOT kept THEN l_partkey END) AS filtered_pids FROM (SELECT l_partkey, l_partkey IN {TOP_UNION} AS kept FROM lineitem)")
def topn_filtered(spark, sf_dir):
    rows = model._table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"))
    judged = topn.judge_top(rows, model.part_states(spark, sf_dir), TOP)
    return judged.agg(F.count_if(~F.col("top_kept")).alias("filtered"), F.count_distinct(F.when(~F.col("top_kept"), F.col("pid"))).alias("filtered_pids"))


@query(f"SELECT count(*) / 50.0::DOUBLE AS ratio FROM {TOP_UNION}")
def topn_ratio(spark, sf_dir):
    return topn.top_union(model.part_states(spark, sf_dir), TOP.n).agg(telemetry.top_ratio(F.count(F.lit(1)), TOP.n).alias("ratio"))


ANY = EnrichConfig(fetch=("command_line", "executable_path"), critical=("process.command_line", "process.executable.path"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS pid, cmdline, exe_path, cmdline IS NULL OR exe_path IS NULL AS warned FROM (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN './run --id ' || s_suppkey END) AS cmdline, CASE WHEN s_suppkey % 5 = 0 THEN '/usr/bin/app-' || s_suppkey END AS exe_path FROM supplier)""")
def enrich_any_missing(spark, sf_dir):
    return enrich.enrich_any(_processes(spark, sf_dir), ANY, **_lookups(spark, sf_dir)).select("pid", "cmdline", "exe_path", "warned")


IO = EnrichConfig(critical=("process.disk.io.read_bytes", "process.command_line"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS pid, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN './run --id ' || s_suppkey END) AS cmdline, s_suppkey * 512.0::DOUBLE AS read_bytes, NULL::VARCHAR AS owner FROM supplier""")
def enrich_critical_only(spark, sf_dir):
    """io is fetched as it is critical, the owner is not."""
    return enrich.enrich_critical(_processes(spark, sf_dir), IO, **_lookups(spark, sf_dir)).select("pid", "cmdline", "read_bytes", "owner")


@query(f"""SELECT 'before' AS stage, count(*) FILTER (s_suppkey % 2 <> 0 AND s_suppkey % 4 <> 1) AS dropped, 0::BIGINT AS warned FROM supplier
UNION ALL SELECT 'after', count(*) FILTER (cmdline IS NULL AND exe_name IS NULL), 0::BIGINT FROM ({ENRICHED})""")
def completeness_gates(spark, sf_dir):
    critical = {"exe_name": F.col("exe_name"), "cmdline": F.col("cmdline")}
    return enrich.gates(_processes(spark, sf_dir), ENRICH, critical, **_lookups(spark, sf_dir))[1]


TTL = EnrichConfig(ttl_seconds=3600, owner_ttl_seconds=7200, path_ttl_seconds=86400)
KIND = "CASE user_id % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'executable_path' ELSE 'command_line' END"


@query(f"""SELECT p.event_id, coalesce(p.ts < c.ts + CASE c.kind WHEN 'owner' THEN INTERVAL 2 HOUR WHEN 'executable_path' THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END, false) AS hit
FROM (SELECT * FROM events WHERE event_type = 'view') p ASOF LEFT JOIN (SELECT *, {KIND} AS kind FROM events WHERE event_type = 'signup') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def cache_ttl_by_kind(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "owner").when(F.col("user_id") % 3 == 1, "executable_path").otherwise("command_line")
    loads = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("loaded_at"), enrich.expires(F.col("ts"), kind, TTL).alias("expires_at"), F.col("event_id").alias("value"), F.lit(False).alias("has_error"))
    return enrich.with_valid_entry(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), loads, "user_id").select("event_id", "hit")


@query("""WITH RECURSIVE s AS (SELECT event_type AS op_type, event_id, ts, event_type = 'error' OR event_id % 3 = 0 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT op_type, 0::BIGINT AS i, NULL::BIGINT AS event_id, true AS allowed, false AS is_open, NULL::TIMESTAMP AS until, 0::BIGINT AS n FROM s UNION ALL
SELECT op_type, i, event_id, allowed, CASE WHEN NOT allowed THEN true ELSE failed AND m + 1 >= 3 END, CASE WHEN allowed AND failed AND m + 1 >= 3 THEN ts + INTERVAL 1 HOUR ELSE until END, CASE WHEN NOT allowed THEN n WHEN failed THEN m + 1 ELSE 0 END
FROM (SELECT s.op_type, s.i, s.event_id, s.ts, s.failed, f.n, f.until, NOT (f.is_open AND s.ts < f.until) AS allowed, CASE WHEN f.is_open THEN 0 ELSE f.n END AS m FROM f JOIN s ON s.op_type = f.op_type AND s.i = f.i + 1))
SELECT op_type, event_id AS seq, allowed, n AS slow_count FROM f WHERE i > 0""")
def circuit_breaker_variant(spark, sf_dir):
    log = model.operation_log(spark, sf_dir).withColumn("ok", F.col("ok") & (F.col("seq") % 3 != 0))
    return enrich.breaker(log, ENRICH, variant=True).select("op_type", "seq", "allowed", "slow_count")


JUMPS = """WITH RECURSIVE f AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL
SELECT user_id, ts FROM (SELECT f.user_id, min(e.ts) AS ts FROM f JOIN events e ON e.user_id = f.user_id AND e.ts {op} f.ts + INTERVAL 36 HOUR GROUP BY f.user_id, f.ts))"""


@query(JUMPS.format(op=">=") + " SELECT user_id, ts FROM f")
def log_throttle(spark, sf_dir):
    return folds.throttle(model._table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", 36 * 3600.0)


@query(JUMPS.format(op=">") + " SELECT e.user_id, f.ts AS window_start, count(*) AS n FROM events e ASOF JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts GROUP BY ALL")
def lazy_windows(spark, sf_dir):
    return folds.lazy_windows(model._table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", 36 * 3600.0)


@query("""SELECT event_id, w AS window_start FROM (SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS w, row_number() OVER (PARTITION BY 1 ORDER BY md5(CAST(event_id AS VARCHAR) || 'reservoir'), CAST(event_id AS VARCHAR)) AS place FROM (SELECT event_id, TIMESTAMP '2024-01-01' AS ts FROM events)) WHERE place <= 5000""")
def reservoir_default_k(spark, sf_dir):
    """The default k, and all rows in one window."""
    e = model._table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("span_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    out = reservoir.reservoir(e, 5000, "1 day", "span_id")
    return out.select("event_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"))


@query("""SELECT * FROM (VALUES ('head', 'probability', 0.9::DOUBLE), ('head', 'other', 7.0::DOUBLE), ('reservoir', 'size_k', 20.0::DOUBLE)) t(id, key, value)""")
def tunables_listed(spark, sf_dir):
    """Register, replace, set within limits, set what is unknown, list."""
    r = TunableRegistry()
    r.register(Tunable("head", {"probability": 0.1}))
    r.register(Tunable("head", {"probability": 0.5, "other": 7}, {"probability": HeadConfig(min_p=0.1, max_p=0.9).clamp}))
    r.register(Tunable("reservoir", {"size_k": 5}))
    done = r.set_value("head", "probability", 3.0), r.set_value("reservoir", "size_k", 20), r.set_value("nobody", "x", 1)
    found = r.lookup("head")[1], r.lookup("nobody")[1], r.get_value("head", "probability"), r.get_value("nobody", "x")
    assert done == (True, True, False) and found == (True, False, (0.9, True), (0.0, False))
    return r.list(spark)


@query("SELECT * FROM (VALUES ('quern.head.received', 'counter', 2::BIGINT, 7.0::DOUBLE), ('own', 'gauge', 1::BIGINT, 5.0::DOUBLE)) t(name, kind, n, total)")
def metric_points(spark, sf_dir):
    """Define, append, ignore the unknown, snapshot."""
    m = telemetry.MetricRegistry()
    m.define("own", "gauge")
    told = [m.update("quern.head.received", 3), m.update("quern.head.received", 4), m.update("own", 5), m.update("unknown", 1)]
    assert told == [True, True, True, False] and m.unknown == 1
    return m.snapshot(spark).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT * FROM (VALUES ('counter', 12::BIGINT), ('gauge', 10::BIGINT), ('histogram', 1::BIGINT)) t(kind, n)")
def metric_catalogue(spark, sf_dir):
    return telemetry.MetricRegistry().catalogue(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('batched', 20::BIGINT, 0::BIGINT, 2::BIGINT), ('full', 0::BIGINT, 3::BIGINT, 0::BIGINT), ('broken', 7::BIGINT, 0::BIGINT, 6::BIGINT)) t(name, sent, dropped, tries)")
def metric_reporting(spark, sf_dir):
    """Batches of ten; a full queue drops; five failures open the breaker for thirty seconds."""
    now, tries, rows = [0.0], [0], []

    def send(batch):
        tries[0] += 1
        if tries[0] <= failing:
            raise OSError

    for name, failing, capacity, points in (("batched", 0, 1000, 20), ("full", 0, 4, 7), ("broken", 5, 1000, 7)):
        now[0], tries[0] = 0.0, 0
        r = telemetry.Reporter(send, capacity=capacity, batch=1 if name == "broken" else 10, every=1e9, clock=lambda: now[0])
        for i in range(points):
            if name == "broken" and i == 6:
                now[0] = 31.0
            r.put(i)
        rows.append((name, r.sent, r.dropped, tries[0]))
    return spark.createDataFrame(rows, "name string, sent long, dropped long, tries long")
