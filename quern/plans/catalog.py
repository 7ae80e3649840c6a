"""Queries over the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import model
from quern.config import ContentFilter, ControllerConfig, CriticalPattern, EnrichConfig, HeadConfig, RecordField, TopNConfig
from quern.functions.hashing import record_hash, span_key, unit_interval
from quern.functions.matching import wildcard
from quern.functions.record_id import record_id
from quern.operators import controller, enrich, head, reservoir, telemetry, topn, traces, transform
from quern.sources import text as sources

_queries: dict = {}
_sql: dict[str, str] = {}

HEAD = HeadConfig(probability=0.25, min_p=0.01, max_p=0.9)
LOGS = HeadConfig(
    probability=0.5,
    mode="record_id",
    record_fields=(RecordField("message"), RecordField("log.level")),
    critical=(CriticalPattern("message", "error user 1*", 2), CriticalPattern("log.level", "purchase", 1)),
    filters=(ContentFilter("resource.service.name", "svc-0", "exclude"), ContentFilter("bucket", "3", "include"), ContentFilter("message", "view*", "weighted", 0.25)),
)
TOP = TopNConfig(n=50, cpu_threshold=0.9, memory_threshold=0.9, idle_ttl="24h")
CONTROL = ControllerConfig(exporters=("click", "view", "error"), high=0.5, low=0.485, min_p=0.01, max_p=0.9)
ENRICH = EnrichConfig(strict=True, slow_ms=100.0, cooldown_seconds=3600.0)
GAP = "6 hours"


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _fold(h: str) -> str:
    return f"xor(('0x' || substr({h}, 1, 16))::UBIGINT, ('0x' || substr({h}, 17, 16))::UBIGINT)"


def _over(h: str) -> str:
    return f"({h}::DOUBLE / 18446744073709551615.0)"


def _unit(h: str) -> str:
    return _over(_fold(h))


def xxhash_sql(rows: str, text: str) -> str:
    """rows with ``acc``: the 64-bit xxHash, seed 0, of an ASCII text of at most 31 bytes, or its
    folded bytes where there are 16 of them. A step a subquery, all modulo 2**64."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    full = "18446744073709551616::UHUGEINT"
    times = lambda a, b: f"(({a})::UHUGEINT * ({b})::UHUGEINT % {full})::UBIGINT"
    plus = lambda a, b: f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {full})::UBIGINT"
    turn = lambda x, r: f"((({x})::UHUGEINT * {2**r}::UHUGEINT) % {full} + (({x}) >> {64 - r})::UHUGEINT)::UBIGINT"
    lane = lambda at, n: "('0x' || " + " || ".join(f"substr(hx, ({at} + {i}) * 2 + 1, 2)" for i in reversed(range(n))) + ")::UBIGINT"
    sql = f"SELECT *, hex({text}) AS hx, length({text}) AS n, {plus(f'length({text})', p5)} AS acc FROM ({rows})"

    def step(when: str, mixed: str, *then: str) -> str:
        out = f"SELECT * REPLACE (CASE WHEN {when} THEN xor(acc, {mixed}) ELSE acc END AS acc) FROM ({sql})"
        for t in then:
            out = f"SELECT * REPLACE (CASE WHEN {when} THEN {t} ELSE acc END AS acc) FROM ({out})"
        return out

    for i in range(3):
        first = times(lane(8 * i, 8), p2)
        sql = f"SELECT *, CASE WHEN n >= {8 * i + 8} THEN {first} ELSE 0 END AS k{i} FROM ({sql})"
        sql = step(f"n >= {8 * i + 8}", times(turn(f"k{i}", 31), p1), turn("acc", 27), plus(times("acc", p1), p4))
    sql = step("n % 8 >= 4", times(lane("(n - n % 8)", 4), p1), turn("acc", 23), plus(times("acc", p2), p3))
    for j in range(3):
        sql = step(f"n % 4 > {j}", times(lane(f"(n - n % 4 + {j})", 1), p5), turn("acc", 11), times("acc", p1))
    for shift, prime in ((33, p2), (29, p3), (32, 1)):
        sql = step("true", f"acc >> {shift}", times("acc", prime))
    return f"SELECT * REPLACE (CASE WHEN n = 16 THEN {_fold('hx')} ELSE acc END AS acc) FROM ({sql})"


EVENTS = "event_id, ts, user_id, event_type, value, event_type || ' user ' || user_id AS body, 'svc-' || (user_id % 5) AS svc, CAST(user_id % 7 AS VARCHAR) AS bucket, hex(substr(md5(CAST(event_id AS VARCHAR)), 1, 16)) AS h FROM events"
CRITICAL = "CASE WHEN regexp_matches(body, '^error user 1.*$') THEN 2 WHEN event_type = 'purchase' THEN 1 END"
ACTION = "CASE WHEN svc = 'svc-0' THEN 'exclude' WHEN bucket = '3' THEN 'include' WHEN regexp_matches(body, '^view.*$') THEN 'weighted' END"


def _kept(unit: str) -> str:
    return f"CASE WHEN {CRITICAL} IS NOT NULL THEN true WHEN {ACTION} = 'include' THEN true WHEN {ACTION} = 'exclude' THEN false WHEN {ACTION} = 'weighted' THEN {unit} < 0.25 ELSE {unit} < 0.5 END"


KEPT = _kept(_unit("h"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs judged under 16 characters of the event's MD5 as record id."""
    ids = F.substring(F.md5(F.col("event_id").cast("string")), 1, 16)
    return head.judge_logs(model.event_logs(spark, sf_dir), LOGS, ids=ids)


@query(f"SELECT md5(CAST(conv_id AS VARCHAR)) AS trace_id, turn, role AS name FROM conversations WHERE {_unit('md5(CAST(conv_id AS VARCHAR))')} < 0.25")
def head_sample_traces(spark, sf_dir):
    spans = head.sample_traces(model.conversation_spans(spark, sf_dir), HEAD)
    return spans.select("trace_id", F.element_at("attributes", "turn").cast("long").alias("turn"), "name")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_unit('md5(CAST(l_orderkey AS VARCHAR))')} < 0.25")
def head_sample_orders(spark, sf_dir):
    rows = model._table(spark, sf_dir, "lineitem").withColumn("trace_id", F.md5(F.col("l_orderkey").cast("string")))
    return head.sample_traces(rows, HEAD).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT event_id, {CRITICAL} AS critical_level, {ACTION} AS action FROM (SELECT {EVENTS}) WHERE {KEPT}")
def log_sample_chain(spark, sf_dir):
    return _logs(spark, sf_dir).filter("kept").select("event_id", "critical_level", "action")


@query("SELECT event_id, array_to_string(list_sort([event_type, 'svc-' || (user_id % 5), CAST(user_id % 7 AS VARCHAR)]), ':') AS equal_id, 'svc-' || (user_id % 5) || ':' || 'svc-' || (user_id % 5) || ':' || CAST(user_id % 7 AS VARCHAR) || ':' || CAST(user_id % 7 AS VARCHAR) || ':' || event_type AS weighted_id FROM events")
def log_record_id(spark, sf_dir):
    from quern.functions.matching import field

    resolve = lambda n: field(n, F.col("body"), F.col("attributes"), F.col("resource"))
    names = ("log.level", "resource.service.name", "bucket")
    equal = [RecordField(n) for n in names]
    weighted = [RecordField(n, w) for n, w in zip(names, (1.0, 2.0, 1.5), strict=True)]
    none = F.lit(None).cast("string")
    return model.event_logs(spark, sf_dir).select("event_id", record_id(equal, resolve, none).alias("equal_id"), record_id(weighted, resolve, none).alias("weighted_id"))


BODIES = "SELECT event_id, event_type, user_id, value, event_type || ' user ' || user_id AS body, 'svc-' || (user_id % 5) AS svc, CAST(user_id % 7 AS VARCHAR) AS bucket FROM events"


@query(f"SELECT event_id, (CASE WHEN acc >= 9223372036854775808 THEN acc::HUGEINT - 18446744073709551616 ELSE acc::HUGEINT END)::BIGINT AS h FROM ({xxhash_sql(BODIES, 'body')})")
def log_record_hash_xx(spark, sf_dir):
    return model.event_logs(spark, sf_dir).select("event_id", record_hash(F.col("body")).alias("h"))


@query(f"SELECT event_id, body FROM ({xxhash_sql(BODIES, chr(40) + 'event_type || ' + chr(39) + ':' + chr(39) + ' || body' + chr(41))}) WHERE {_kept(_over('acc'))}")
def log_sample_by_record(spark, sf_dir):
    return head.sample_logs(model.event_logs(spark, sf_dir), LOGS).select("event_id", "body")


@query("SELECT p_partkey, regexp_matches(p_type, '^.*STEEL$') AS ends, regexp_matches(p_brand, '^Brand#1.*$') AS starts, p_name = 'x' AS equals, p_type IS NOT NULL AS anything, regexp_matches(p_name, '^.*a.*e.*$') AS inner_match FROM part")
def wildcard_match(spark, sf_dir):
    p = model._table(spark, sf_dir, "part")
    return p.select("p_partkey", wildcard(F.col("p_type"), "*STEEL").alias("ends"), wildcard(F.col("p_brand"), "Brand#1*").alias("starts"), wildcard(F.col("p_name"), "x").alias("equals"), wildcard(F.col("p_type"), "*").alias("anything"), wildcard(F.col("p_name"), "*a*e*").alias("inner_match"))


@query(f"SELECT coalesce(action, 'none') AS action, count(*) AS n, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_rejected FROM (SELECT {ACTION} AS action, {KEPT} AS kept FROM (SELECT {EVENTS})) GROUP BY 1")
def content_filter_counts(spark, sf_dir):
    rows = _logs(spark, sf_dir).groupBy(F.coalesce("action", F.lit("none")).alias("action"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"), telemetry.rejected(F.col("kept")).alias("n_rejected"))


@query(f"SELECT critical_level, count(*) AS n FROM (SELECT {CRITICAL} AS critical_level FROM (SELECT {EVENTS})) WHERE critical_level IS NOT NULL GROUP BY 1")
def critical_by_level(spark, sf_dir):
    return _logs(spark, sf_dir).filter("critical_level is not null").groupBy("critical_level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) AS window_start, count(*) / 10.0::DOUBLE AS rate FROM events GROUP BY 1")
def sample_throughput_10s(spark, sf_dir):
    return telemetry.throughput(model._table(spark, sf_dir, "events"))


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT kept) AS rejected FROM (SELECT {_unit('md5(CAST(conv_id AS VARCHAR))')} < 0.25 AS kept FROM conversations)")
def sample_rejected(spark, sf_dir):
    from quern.functions.hashing import fold_hash

    kept = unit_interval(fold_hash(F.col("trace_id"))) < HEAD.probability
    return model.conversation_spans(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), telemetry.rejected(kept).alias("rejected"))


@query("SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id, count(*) AS n_spans, bool_or(l_linenumber = 1) AS has_root, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem GROUP BY 1")
def assemble_traces(spark, sf_dir):
    return traces.assemble(model.order_spans(spark, sf_dir))


SESSIONS = """WITH a AS (SELECT user_id, ts, event_type = 'signup' AS root, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT user_id, count(*) AS n_spans, bool_or(root) AS has_root, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY user_id, s)"""


def _user_spans(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("trace_id"), "ts", F.when(F.col("event_type") == "signup", "").otherwise("x").alias("parent_span_id"))


@query(SESSIONS + " SELECT user_id, n_spans, has_root, first_ts, last_ts FROM c")
def trace_sessions_timeout(spark, sf_dir):
    return traces.sessions(_user_spans(spark, sf_dir), GAP).withColumnRenamed("trace_id", "user_id")


@query(SESSIONS + " SELECT count(*) FILTER (has_root) AS complete, count(*) FILTER (NOT has_root) AS timed_out FROM c")
def complete_vs_timeout(spark, sf_dir):
    s = traces.sessions(_user_spans(spark, sf_dir), GAP)
    return s.agg(F.count_if("has_root").alias("complete"), F.count_if(~F.col("has_root")).alias("timed_out"))


@query("SELECT md5(CAST(conv_id AS VARCHAR)) AS trace_id, role AS scope, 'service-' || (conv_id % 3) AS service_name, count(*) AS n_spans FROM conversations GROUP BY ALL")
def regroup_by_resource(spark, sf_dir):
    out = traces.regroup(model.conversation_spans(spark, sf_dir))
    service = F.regexp_extract("resource_key", r'"key":"service.name","value":"([^"]*)"', 1)
    return out.select("trace_id", F.col("scope.name").alias("scope"), service.alias("service_name"), "n_spans")


@query("""WITH t AS (SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id, min(l_shipdate) AS ts FROM lineitem GROUP BY 1),
r AS (SELECT trace_id, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS w, row_number() OVER (PARTITION BY time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') ORDER BY md5(trace_id || 'reservoir'), trace_id) AS place FROM t)
SELECT l_orderkey, l_linenumber, l_quantity, w AS window_start FROM lineitem JOIN r ON md5(CAST(l_orderkey AS VARCHAR)) = trace_id WHERE place <= 20""")
def reservoir_traces(spark, sf_dir):
    li = model._table(spark, sf_dir, "lineitem").withColumn("trace_id", F.md5(F.col("l_orderkey").cast("string"))).withColumn("ts", F.col("l_shipdate"))
    return reservoir.trace_reservoir(li, 20, "30 days").select("l_orderkey", "l_linenumber", "l_quantity", "window_start")


@query("""SELECT event_id, w AS window_start FROM (SELECT event_id, date_trunc('hour', ts) AS w, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY md5(CAST(event_id AS VARCHAR) || 'reservoir'), CAST(event_id AS VARCHAR)) AS place FROM events) WHERE place <= 5""")
def reservoir_spans(spark, sf_dir):
    e = model._table(spark, sf_dir, "events").withColumn("span_id", F.col("event_id").cast("string"))
    return reservoir.reservoir(e, 5, "1 hour", "span_id").select("event_id", "window_start")


@query("SELECT date_trunc('hour', ts) AS window_start, count(DISTINCT user_id) AS seen, least(count(DISTINCT user_id), 10) AS kept, count(DISTINCT user_id) - least(count(DISTINCT user_id), 10) AS dropped FROM events GROUP BY 1")
def reservoir_window_stats(spark, sf_dir):
    return reservoir.window_stats(model._table(spark, sf_dir, "events"), 10, "1 hour", "user_id")


SUMMARY = """SELECT md5(CAST(conv_id AS VARCHAR)) AS trace_id, substr(md5(conv_id || ':' || turn), 1, 16) AS span_id, CASE WHEN turn > 0 THEN substr(md5(conv_id || ':0'), 1, 16) END AS parent_span_id, role AS name, 'internal' AS kind,
(1704067200 + conv_id * 20 + turn * 5) * 1000000000 AS start_ns, (1704067200 + conv_id * 20 + turn * 5) * 1000000000 + length(text) * 1000000 AS end_ns, CASE WHEN length(text) > 200 THEN 2 ELSE 1 END AS status_code, NULL::VARCHAR AS status_message,
'service-' || (conv_id % 3) AS service_name, CASE WHEN conv_id % 2 = 0 THEN 't' || (conv_id % 4) END AS tenant_id FROM conversations"""


@query(SUMMARY)
def span_summary(spark, sf_dir):
    return traces.summaries(model.conversation_spans(spark, sf_dir))


@query(f"SELECT service_name, coalesce(tenant_id, 'default') AS tenant_id, count(*) AS n, min(start_ns) AS first_ns FROM ({SUMMARY}) GROUP BY ALL")
def span_summary_regroup(spark, sf_dir):
    rows = traces.from_summaries(traces.summaries(model.conversation_spans(spark, sf_dir)))
    return rows.groupBy("service_name", "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("first_ns"))


@query("SELECT md5(CAST(conv_id AS VARCHAR)) || '-' || substr(md5(conv_id || ':' || turn), 1, 16) AS span_key FROM conversations")
def span_keys(spark, sf_dir):
    return model.conversation_spans(spark, sf_dir).select(span_key(F.col("trace_id"), F.col("span_id")).alias("span_key"))


@query(f"SELECT md5(CAST(conv_id AS VARCHAR)) AS trace_id, substr(md5(conv_id || ':' || turn), 1, 16) AS span_id FROM conversations WHERE NOT ({_unit('md5(CAST(conv_id AS VARCHAR))')} < 0.25)")
def lost_span_keys(spark, sf_dir):
    spans = model.conversation_spans(spark, sf_dir)
    return traces.lost_keys(spans.select("trace_id", "span_id"), head.sample_traces(spans, HEAD).select("trace_id", "span_id"))


STATES = "SELECT p_partkey AS pid, p_retailprice AS cpu, CAST(p_size AS DOUBLE) AS mem FROM part"
TOP_UNION = f"(SELECT pid FROM ({STATES} ORDER BY p_retailprice DESC, p_partkey LIMIT 50) UNION SELECT pid FROM ({STATES} ORDER BY p_size DESC, p_partkey LIMIT 50))"


@query(f"SELECT pid, cpu FROM ({STATES} ORDER BY p_retailprice DESC, p_partkey LIMIT 50)")
def topn_cpu(spark, sf_dir):
    return topn.top(model.part_states(spark, sf_dir), "cpu", TOP.n).select("pid", "cpu")


@query(f"SELECT pid, mem FROM ({STATES} ORDER BY p_size DESC, p_partkey LIMIT 50)")
def topn_mem(spark, sf_dir):
    return topn.top(model.part_states(spark, sf_dir), "mem", TOP.n).select("pid", "mem")


@query(f"SELECT pid FROM {TOP_UNION}")
def topn_union(spark, sf_dir):
    return topn.top_union(model.part_states(spark, sf_dir), TOP.n)


@query(f"SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN l_partkey END AS pid, l_quantity FROM lineitem WHERE l_linenumber = 1 OR l_partkey IN {TOP_UNION}")
def topn_filter(spark, sf_dir):
    rows = model._table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("pid"), "l_quantity")
    return topn.keep_top(rows, model.part_states(spark, sf_dir), TOP)


POINTS = "SELECT CASE WHEN event_type IN ('click', 'view') THEN user_id END AS pid, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'mem' ELSE 'host' END AS name, value, ts, event_id AS seq FROM events"


@query(f"SELECT pid, coalesce(arg_max(value, (ts, seq)) FILTER (name = 'cpu'), 0.0)::DOUBLE AS cpu, coalesce(arg_max(value, (ts, seq)) FILTER (name = 'mem'), 0.0)::DOUBLE AS mem, max(ts) AS last_updated FROM ({POINTS}) WHERE pid IS NOT NULL GROUP BY pid")
def process_latest_state(spark, sf_dir):
    return topn.latest_state(model.process_points(spark, sf_dir))


ABOVE = f"SELECT pid, seq, ts, max(CASE WHEN value >= 90 THEN ts END) OVER (PARTITION BY pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last_above FROM ({POINTS}) WHERE pid IS NOT NULL"


def _above(spark, sf_dir):
    p = model.process_points(spark, sf_dir).filter("pid is not null")
    ratio = lambda n: F.when(F.col("name") == n, F.col("value") / 100).otherwise(0.0)
    return topn.last_above(p.withColumn("cpu", ratio("cpu")).withColumn("mem", ratio("mem")), TOP)


@query(f"SELECT pid, seq, last_above FROM ({ABOVE})")
def last_above_threshold(spark, sf_dir):
    return _above(spark, sf_dir).select("pid", "seq", "last_above")


@query(f"SELECT pid, last_above FROM (SELECT pid, max(last_above) AS last_above FROM ({ABOVE}) GROUP BY pid) WHERE TIMESTAMP '2024-01-30 12:00:00' - last_above <= INTERVAL 24 HOUR")
def idle_evict(spark, sf_dir):
    states = _above(spark, sf_dir).groupBy("pid").agg(F.max("last_above").alias("last_above"))
    return topn.evict_idle(states, "2024-01-30 12:00:00", TOP.idle_ttl)


@query("SELECT c_custkey, 'cust-' || c_mktsegment AS service_name, 'quern' AS sdk_name, 2 AS n_keys FROM customer")
def resource_upsert(spark, sf_dir):
    c = model._table(spark, sf_dir, "customer").withColumn("resource", F.create_map(F.lit("service.name"), "c_name"))
    c = c.withColumn("resource", transform.upsert(F.col("resource"), {"service.name": F.concat(F.lit("cust-"), "c_mktsegment"), "telemetry.sdk.name": F.lit("quern"), "absent": F.lit(None).cast("string")}))
    return c.select("c_custkey", F.element_at("resource", "service.name").alias("service_name"), F.element_at("resource", "telemetry.sdk.name").alias("sdk_name"), F.size("resource").alias("n_keys"))


@query("SELECT c_custkey, sha256('salt' || c_name) AS c_name FROM customer")
def pii_hash(spark, sf_dir):
    return model._table(spark, sf_dir, "customer").select("c_custkey", transform.hash_pii(F.col("c_name"), "salt").alias("c_name"))


@query("""SELECT p_partkey, CASE WHEN exe = 'java' THEN regexp_replace(cmd, '^.*-jar\\s+([^\\s]+).*$', 'java -jar \\1') ELSE exe || ' ' || substr(cmd, 1, 50) END AS display_name, p_brand AS process_group
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'java' ELSE 'app' END AS exe, 'run -Xmx1g -jar ' || replace(p_type, ' ', '_') || '.jar ' || p_name || ' --size ' || p_size AS cmd FROM part)""")
def normalize_names(spark, sf_dir):
    p = model._table(spark, sf_dir, "part").withColumn("exe", F.when(F.col("p_size") % 2 == 0, "java").otherwise("app"))
    p = p.withColumn("cmd", F.concat(F.lit("run -Xmx1g -jar "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".jar "), "p_name", F.lit(" --size "), F.col("p_size").cast("string")))
    return p.select("p_partkey", transform.display_name(F.col("exe"), F.col("cmd")).alias("display_name"), transform.process_group(F.col("p_brand")).alias("process_group"))


@query("SELECT s_suppkey, s_name AS name, false AS has_pid FROM supplier")
def drop_key(spark, sf_dir):
    s = model._table(spark, sf_dir, "supplier").withColumn("m", F.create_map(F.lit("process.pid"), F.col("s_suppkey").cast("string"), F.lit("name"), "s_name"))
    m = transform.drop_key(F.col("m"), "process.pid")
    return s.select("s_suppkey", F.element_at(m, "name").alias("name"), F.map_contains_key(m, "process.pid").alias("has_pid"))


@query("SELECT coalesce(nullif(c_mktsegment, 'MACHINERY'), 'default') AS tenant, count(*) AS n, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS cents FROM customer GROUP BY 1")
def route_tenant(spark, sf_dir):
    c = model._table(spark, sf_dir, "customer").withColumn("tenant", transform.tenant(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))))
    return c.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def attach_metadata(spark, sf_dir):
    n = model._table(spark, sf_dir, "nation").join(model._table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = model._table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey"))
    return transform.attach_metadata(c, n.select(F.col("n_nationkey").alias("k"), "n_name", "r_name"), "k").select("c_custkey", "c_name", "n_name", "r_name")


def _processes(spark, sf_dir):
    s = model._table(spark, sf_dir, "supplier")
    null = F.lit(None).cast("string")
    return s.select(F.col("s_suppkey").cast("string").alias("pid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("cmdline"), null.alias("owner"), null.alias("exe_path"), F.when(F.col("s_suppkey") % 4 == 1, "named").alias("exe_name"), F.lit(None).cast("double").alias("read_bytes"), F.lit(None).cast("double").alias("write_bytes"))


def _lookups(spark, sf_dir):
    s = model._table(spark, sf_dir, "supplier")
    pid = F.col("s_suppkey").cast("int").alias("pid")
    io = F.concat(F.lit("rchar: 1\nread_bytes: "), (F.col("s_suppkey") * 512).cast("string"), F.lit("\n"))
    status = F.concat(F.lit("Name:\tx\nUid:\t"), F.col("s_nationkey").cast("string"), F.lit("\t0\n"))
    return {
        "cmdline": s.filter("s_suppkey % 3 = 0").select(pid, sources.command_line(F.concat(F.lit("./run\0--id\0"), F.col("s_suppkey").cast("string"), F.lit("\0"))).alias("cmdline")),
        "status": s.select(pid, sources.status_uid(status).alias("uid")),
        "passwd": model._table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("uid"), F.col("n_name").alias("username")),
        "exe": s.filter("s_suppkey % 5 = 0").select(pid, F.concat(F.lit("/usr/bin/app-"), F.col("s_suppkey").cast("string")).alias("path")),
        "io": s.select(pid, sources.io_bytes(io, "read_bytes").alias("read_bytes"), sources.io_bytes(io, "write_bytes").alias("write_bytes")),
    }


ENRICHED = """SELECT CAST(s_suppkey AS VARCHAR) AS pid, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN './run --id ' || s_suppkey END) AS cmdline,
coalesce(n_name, 'uid:' || s_nationkey) AS owner, CASE WHEN s_suppkey % 5 = 0 THEN '/usr/bin/app-' || s_suppkey END AS exe_path,
coalesce(CASE WHEN s_suppkey % 4 = 1 THEN 'named' END, CASE WHEN s_suppkey % 5 = 0 THEN 'app-' || s_suppkey END) AS exe_name, s_suppkey * 512.0::DOUBLE AS read_bytes, 0.0::DOUBLE AS write_bytes
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey"""


def _enriched(spark, sf_dir):
    out = enrich.enrich(_processes(spark, sf_dir), ENRICH, **_lookups(spark, sf_dir))
    return out.withColumn("missing", enrich.missing({"exe_name": F.col("exe_name"), "cmdline": F.col("cmdline")}))


@query(ENRICHED)
def enrich_lookup(spark, sf_dir):
    return _enriched(spark, sf_dir).drop("missing")


@query(f"SELECT pid, concat_ws(',', CASE WHEN exe_name IS NULL THEN 'exe_name' END, CASE WHEN cmdline IS NULL THEN 'cmdline' END) AS missing FROM ({ENRICHED})")
def critical_missing(spark, sf_dir):
    return _enriched(spark, sf_dir).select("pid", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT pid, cmdline, exe_name FROM ({ENRICHED}) WHERE NOT (cmdline IS NULL AND exe_name IS NULL)")
def completeness_gate(spark, sf_dir):
    return enrich.gate(_enriched(spark, sf_dir), "missing", "pid", ENRICH.strict).select("pid", "cmdline", "exe_name")


@query("SELECT page_id, nullif(string_split(url, '/')[-1], '') AS exe_name FROM pages")
def exec_name(spark, sf_dir):
    return model._table(spark, sf_dir, "pages").select("page_id", enrich.executable_name(F.lit(None).cast("string"), F.col("url")).alias("exe_name"))


def _probes(spark, sf_dir):
    e = model._table(spark, sf_dir, "events")
    loads = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("loaded_at"), (F.col("ts") + F.expr("interval 12 hours")).alias("expires_at"), F.col("event_id").alias("value"), (F.col("event_id") % 10 == 0).alias("has_error"))
    return enrich.with_valid_entry(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), loads, "user_id")


ASOF = """SELECT p.event_id, p.user_id, coalesce(p.ts < c.ts + INTERVAL 12 HOUR, false) AS hit, CASE WHEN p.ts < c.ts + INTERVAL 12 HOUR AND c.event_id % 10 <> 0 THEN c.event_id END AS value
FROM (SELECT * FROM events WHERE event_type = 'view') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') c ON p.user_id = c.user_id AND p.ts >= c.ts"""


@query(ASOF)
def cache_asof(spark, sf_dir):
    return _probes(spark, sf_dir).select("event_id", "user_id", "hit", "value")


@query(f"SELECT round(count(*) FILTER (hit) / count(*), 9) AS ratio FROM ({ASOF})")
def cache_hit_ratio(spark, sf_dir):
    return _probes(spark, sf_dir).agg(F.round(telemetry.hit_ratio(F.col("hit")), 9).alias("ratio"))


UTIL = "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, sum(floor(value))::DOUBLE / (count(*) * 100.0::DOUBLE) AS x FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1"
STEPS = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM ({UTIL})),
f AS (SELECT 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS x, 0.0::DOUBLE AS ewma, 0.25::DOUBLE AS p, 0 AS run UNION ALL
SELECT i, ts, x, e, greatest(0.01::DOUBLE, least(0.9::DOUBLE, p * CASE WHEN e > 0.5 AND r >= 3 THEN 0.5::DOUBLE WHEN e > 0.5 THEN 0.8::DOUBLE WHEN e < 0.485 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END)), CASE WHEN e > 0.5 AND r >= 3 THEN 0 ELSE r END
FROM (SELECT s.i, s.ts, s.x, 0.3::DOUBLE * s.x + (1.0::DOUBLE - 0.3::DOUBLE) * f.ewma AS e, f.p, CASE WHEN 0.3::DOUBLE * s.x + (1.0::DOUBLE - 0.3::DOUBLE) * f.ewma > 0.5 THEN f.run + 1 ELSE 0 END AS r FROM f JOIN s ON s.i = f.i + 1))"""


def _steps(spark, sf_dir):
    return controller.steps(controller.utilization(model.queue_days(spark, sf_dir), CONTROL), CONTROL, 0.25)


@query(f"SELECT ts, round(x, 9) AS x FROM ({UTIL})")
def queue_utilization(spark, sf_dir):
    return controller.utilization(model.queue_days(spark, sf_dir), CONTROL).select("ts", F.round("x", 9).alias("x"))


@query(STEPS + " SELECT ts, round(ewma, 9) AS ewma FROM f WHERE i > 0")
def ewma(spark, sf_dir):
    return _steps(spark, sf_dir).select("ts", F.round("ewma", 9).alias("ewma"))


@query(STEPS + " SELECT ts, round(p, 9) AS p FROM f WHERE i > 0")
def controller_steps(spark, sf_dir):
    return _steps(spark, sf_dir).select("ts", F.round("p", 9).alias("p"))


@query(STEPS + f" SELECT e.event_id, round(f.p, 9) AS p FROM events e ASOF JOIN (SELECT * FROM f WHERE i > 0) f ON e.ts >= f.ts WHERE {_unit('md5(CAST(e.event_id AS VARCHAR))')} < f.p")
def adaptive_sample(spark, sf_dir):
    from quern.functions.hashing import fold_hash

    e = controller.probability_at(model._table(spark, sf_dir, "events").select("event_id", "ts"), _steps(spark, sf_dir).select("ts", "p"), 0.25)
    return e.filter(unit_interval(fold_hash(F.md5(F.col("event_id").cast("string")))) < F.col("p")).select("event_id", F.round("p", 9).alias("p"))


@query("""WITH RECURSIVE s AS (SELECT event_type AS op_type, event_id, ts, event_type = 'error' OR value > 100 AS slow, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT op_type, 0::BIGINT AS i, NULL::BIGINT AS event_id, true AS allowed, false AS is_open, NULL::TIMESTAMP AS until, 0::BIGINT AS n FROM s UNION ALL
SELECT s.op_type, s.i, s.event_id, NOT (f.is_open AND s.ts < f.until),
CASE WHEN f.is_open AND s.ts < f.until THEN true WHEN s.slow THEN f.is_open OR f.n + 1 >= 3 ELSE false END,
CASE WHEN NOT f.is_open AND s.slow AND f.n + 1 >= 3 THEN s.ts + INTERVAL 1 HOUR ELSE f.until END,
CASE WHEN f.is_open AND s.ts < f.until THEN f.n WHEN s.slow THEN f.n + 1 ELSE 0 END FROM f JOIN s ON s.op_type = f.op_type AND s.i = f.i + 1)
SELECT op_type, event_id AS seq, allowed, CASE WHEN is_open THEN 'open' ELSE 'closed' END AS state, n AS slow_count FROM f WHERE i > 0""")
def circuit_breaker_fold(spark, sf_dir):
    return enrich.breaker(model.operation_log(spark, sf_dir), ENRICH).select("op_type", "seq", "allowed", "state", "slow_count")


@query("SELECT event_id, CASE WHEN value * 10 < 100 THEN '<100ms' WHEN value * 10 < 500 THEN '100-500ms' WHEN value * 10 < 1000 THEN '500ms-1s' ELSE '>1s' END AS tier FROM events")
def duration_tiers(spark, sf_dir):
    return model._table(spark, sf_dir, "events").select("event_id", enrich.duration_tier(F.col("value") * 10).alias("tier"))


@query("SELECT trim(string_split(props, ':')[-1]) AS error_class, count(*) AS n FROM events GROUP BY 1")
def error_classes(spark, sf_dir):
    return model._table(spark, sf_dir, "events").groupBy(enrich.error_class(F.col("props")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, round((max(event_id) - min(event_id)) / 86400.0::DOUBLE, 9) AS rate FROM events GROUP BY 1, 2")
def metric_rate(spark, sf_dir):
    e = model._table(spark, sf_dir, "events").withColumn("value", F.col("event_id").cast("double"))
    return telemetry.rate(e, "1 day", 86400.0, "event_type").withColumn("rate", F.round("rate", 9))


@query("""WITH c AS (SELECT event_type, 0.95::DOUBLE * count(*) AS r, count(*) FILTER (value <= 10) AS b0, count(*) FILTER (value <= 50) AS b1, count(*) FILTER (value <= 100) AS b2, count(*) FILTER (value <= 250) AS b3, count(*) FILTER (value <= 500) AS b4 FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN b0 >= r THEN 10 * r / b0 WHEN b1 >= r THEN 10 + 40 * (r - b0) / (b1 - b0) WHEN b2 >= r THEN 50 + 50 * (r - b1) / (b2 - b1) WHEN b3 >= r THEN 100 + 150 * (r - b2) / (b3 - b2) WHEN b4 >= r THEN 250 + 250 * (r - b3) / (b4 - b3) ELSE 500 END, 6) AS quantile FROM c""")
def histogram_quantile(spark, sf_dir):
    out = telemetry.histogram_quantile(model._table(spark, sf_dir, "events"), 0.95, [10.0, 50.0, 100.0, 250.0, 500.0], "event_type")
    return out.withColumn("quantile", F.round("quantile", 6))


@query("SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS middle, arg_min(p_partkey::VARCHAR, (p_retailprice, p_partkey::VARCHAR)) AS fastest, arg_max(p_partkey::VARCHAR, (p_retailprice, p_partkey::VARCHAR)) AS slowest, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1")
def bench_summary(spark, sf_dir):
    p = model._table(spark, sf_dir, "part")
    lines = p.select(F.col("p_brand"), F.format_string("Benchmark%d-8 %d %s ns/op", "p_partkey", "p_size", F.col("p_retailprice").cast("string")).alias("value"))

    rows = sources.benchmark_lines(lines.select("value")).join(p.select(F.col("p_partkey").cast("string").alias("name"), "p_brand"), "name")
    out = telemetry.benchmark_summary(rows, "p_brand")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("middle", F.round("middle", 6))


@query("SELECT event_type, event_id, CAST(sum(floor(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def cumulative_counter(spark, sf_dir):
    e = model._table(spark, sf_dir, "events").withColumn("value", F.floor("value"))
    return telemetry.cumulative(e, "event_type", then=("event_id",)).select("event_type", "event_id", F.col("total").cast("long").alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-sampled conversations, then all spans of a reservoir of traces an hour."""
    spans = head.sample_traces(model.conversation_spans(spark, sf_dir), HeadConfig(probability=0.9))
    return reservoir.trace_reservoir(spans, 50, "1 hour").select("trace_id", "span_id", "name", "start_ns", "window_start")


def queries() -> dict:
    from quern.plans import catalog_more  # noqa: F401  (it registers its own)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from quern.plans import catalog_more  # noqa: F401

    return dict(_sql)
