"""URL filters by link-graph propagation.

Explicit rules judge what they fit. All other urls get their host's verdict: trust flows
along links between hosts as personalised PageRank from hosts whose pages rules allow,
distrust flows against them from hosts whose pages rules block (who links to a blocked host
is suspect), and a host is blocked when distrust is more than ``share`` of both. Hosts that
neither reaches are allowed.

Only DataFrame functions run. A link table holds a row for each linked pair of hosts; every
round is two joins and one sum over it, written to the shared folder, so a host with many
links is partial sums and joins that Spark may split, and a lost executor costs one round.
Rounds go on until the ranks have settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: Propagation ends when all ranks together change by less (trust and distrust each sum to 1).
TOLERANCE = 1e-6
SHARE = 0.5
HREF = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s<>]+)"""


def _lowered(host: Column) -> Column:
    """A-Z alone, as hosts of urls and of links must meet."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust from links (src, dst, w) and seeds (host, good, bad), which sum to 1.

    Rounds go on until all ranks together change by less than ``tolerance``; each shrinks the
    change by ``damping`` at least, so that takes log(tolerance / 2) / log(damping) rounds at most."""
    if links.isEmpty():
        return seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    out = materialize(links.groupBy("src").agg(F.sum("w").alias("w_out")), "out-weights")
    into = materialize(links.groupBy("dst").agg(F.sum("w").alias("w_in")), "in-weights")
    edges = materialize(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.col("w_out")).alias("ahead"), (F.col("w") / F.col("w_in")).alias("back")), "edges")
    zero = F.lit(0.0)
    ends = [out.select(F.col("src").alias("host"), zero.alias("good"), zero.alias("bad"), F.lit(True).alias("leads"), F.lit(False).alias("led"))]
    ends.append(into.select(F.col("dst").alias("host"), zero.alias("good"), zero.alias("bad"), F.lit(False).alias("leads"), F.lit(True).alias("led")))
    hosts = seeds.select("host", "good", "bad", F.lit(False).alias("leads"), F.lit(False).alias("led")).unionByName(ends[0]).unionByName(ends[1])
    hosts = hosts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.bool_or("leads").alias("leads"), F.bool_or("led").alias("led"))
    kept = ["host", "good", "bad", "leads", "led"]
    now = materialize(hosts.select(*kept, F.col("good").alias("trust"), F.col("bad").alias("distrust"), F.lit(2.0).alias("change")), "ranks")
    while True:
        # what hosts hold that link to none (distrust: that none links to) goes back to the seeds
        lost_t, lost_d, change = (x or 0.0 for x in now.agg(F.sum(F.when(~F.col("leads"), F.col("trust"))), F.sum(F.when(~F.col("led"), F.col("distrust"))), F.sum("change")).first())
        if change < tolerance:
            release(out, into, edges)
            return now.select("host", "trust", "distrust")
        ahead = edges.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("t"), zero.alias("d"))
        back = edges.join(now, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        moved = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        t = (1 - damping) * F.col("good") + damping * (F.coalesce("t", zero) + F.lit(lost_t) * F.col("good"))
        d = (1 - damping) * F.col("bad") + damping * (F.coalesce("d", zero) + F.lit(lost_d) * F.col("bad"))
        new = now.join(moved, "host", "left").select(*kept, t.alias("trust"), d.alias("distrust"), (F.abs(t - F.col("trust")) + F.abs(d - F.col("distrust"))).alias("change"))
        new = materialize(new, "ranks")
        release(now)
        now = new


def judge(pages: DataFrame, rules=RULES, *, tolerance: float = TOLERANCE, share: float = SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages.

    A null url, or one without ``://``, has an empty host and path. Null or empty html has no
    links; of a very long one all links count. Of rules that fit the longest decides; a host
    with as much trust as distrust is allowed. Repeated rows are each judged (and count as
    seeds each); further columns are ignored; no rows give no rows; page_id may be null.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_columns(rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    judged = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = judged.groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
    seeds = materialize(seeds, "seeds")
    a, b = seeds.agg(F.sum("a"), F.sum("b")).first()
    seeds = seeds.select("host", (F.col("a") / F.lit(float(a or 1))).alias("good"), (F.col("b") / F.lit(float(b or 1))).alias("bad"))
    target = F.explode(F.expr(f"regexp_extract_all(html, r'{HREF.replace(chr(39), chr(92) + 'x27')}', 1)"))
    links = named.filter("host <> ''").select(F.col("host").alias("src"), target.alias("dst")).withColumn("dst", _lowered(F.col("dst")))
    links = materialize(links.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "host-links")
    ranks = propagate(links, seeds, tolerance)
    bad = F.col("distrust") > F.lit(share) * (F.col("trust") + F.col("distrust"))
    ranks = materialize(ranks.select(F.col("host").alias("of"), "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("by_links")), "verdicts")
    out = judged.join(ranks, F.col("host") == F.col("of"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_links", F.lit("allow")).alias("verdict"), "trust", "distrust")


def op1_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


#: SQL has no loop that ends by itself here: after so many rounds nothing changes by 1e-6.
SQL_ROUNDS = 90


def _sql() -> str:
    rules = "".join(f" WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1])))
    verdicts = "".join(f" WHEN '{r}' THEN '{v}'" for v, r in RULES)
    steps = ""
    for i in range(SQL_ROUNDS):
        steps += f""", m{i} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (
  SELECT dst AS host, trust * ahead AS t, 0.0::DOUBLE AS d FROM edges JOIN r{i} ON src = host UNION ALL
  SELECT src, 0.0::DOUBLE, distrust * back FROM edges JOIN r{i} ON dst = host) GROUP BY host),
r{i + 1} AS (SELECT host, {1 - DAMPING} * good + {DAMPING} * (coalesce(t, 0) + (1 - coalesce((SELECT sum(t) FROM m{i}), 0)) * good) AS trust,
  {1 - DAMPING} * bad + {DAMPING} * (coalesce(d, 0) + (1 - coalesce((SELECT sum(d) FROM m{i}), 0)) * bad) AS distrust FROM hosts LEFT JOIN m{i} USING (host))"""
    href = HREF.replace("'", "''")
    return f"""WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, CASE{rules} END AS rule, CASE (CASE{rules} END){verdicts} END AS by_rule FROM named),
s AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM judged GROUP BY host),
seeds AS (SELECT host, a / (SELECT greatest(sum(a), 1) FROM s)::DOUBLE AS good, b / (SELECT greatest(sum(b), 1) FROM s)::DOUBLE AS bad FROM s),
l AS (SELECT src, dst, count(*) AS w FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM named WHERE host <> '') WHERE src <> dst GROUP BY src, dst),
edges AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS ahead, w / sum(w) OVER (PARTITION BY dst) AS back FROM l),
hosts AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT * FROM seeds UNION ALL SELECT src, 0.0::DOUBLE, 0.0::DOUBLE FROM l UNION ALL SELECT dst, 0.0::DOUBLE, 0.0::DOUBLE FROM l) GROUP BY host),
r0 AS (SELECT host, good AS trust, bad AS distrust FROM hosts){steps}
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > {SHARE} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN r{SQL_ROUNDS} USING (host)"""


SQL = _sql()
