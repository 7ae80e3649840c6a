import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quern.llm import op1_urls
from quern.llm.op1_urls import judge, propagate


def brute(pages, rounds=120, d=0.85):
    import re

    got, links, seeds = [], defaultdict(int), {}
    for pid, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for v, r in op1_urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fit) if fit else (0, None, None)
        got.append((pid, host, path, rule[1], rule[2]))
        s = seeds.setdefault(host, [0, 0])
        s[0] += rule[2] == "allow"
        s[1] += rule[2] == "block"
        for to in re.findall(op1_urls.HREF, html or ""):
            to = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in to)
            if host and to != host:
                links[host, to] += 1
    for a, b in links:
        seeds.setdefault(a, [0, 0]), seeds.setdefault(b, [0, 0])
    na, nb = max(1, sum(s[0] for s in seeds.values())), max(1, sum(s[1] for s in seeds.values()))
    good, bad = {h: s[0] / na for h, s in seeds.items()}, {h: s[1] / nb for h, s in seeds.items()}
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), w in links.items():
        out[a] += w
        into[b] += w
    t, u = dict(good), dict(bad)
    for _ in range(rounds if links else 0):
        nt, nu = defaultdict(float), defaultdict(float)
        for (a, b), w in links.items():
            nt[b] += t[a] * w / out[a]
            nu[a] += u[b] * w / into[b]
        lt, lu = 1 - sum(nt.values()), 1 - sum(nu.values())
        t = {h: (1 - d) * good[h] + d * (nt[h] + lt * good[h]) for h in seeds}
        u = {h: (1 - d) * bad[h] + d * (nu[h] + lu * bad[h]) for h in seeds}
    return {(p, h, x, r, v or ("block" if u[h] > 0.5 * (t[h] + u[h]) else "allow")) for p, h, x, r, v in got}


def made():
    rng = random.Random(5)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "net", "org")]
    pages = []
    for i in range(300):
        h = rng.choice(hosts)
        links = "".join(f'<a href="{rng.choice(["http://", "https://", "//"])}{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/x">y</a>' for _ in range(rng.randint(0, 3)))
        pages.append((i, f"https://{h}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 90)}{rng.choice(['', '?a=/en/7', '#x'])}", links + '<a href="/local">z</a>'))
    return pages + [(900, None, None), (901, "no scheme", "x"), (902, "HTTP://COM/en/", ""), (902, "HTTP://COM/en/", ""), (None, "ftp://Example.COM/en/7x", ""), (903, "https://notcom/en/1", None)]


def test_made_links(spark):
    pages = made()
    df = spark.createDataFrame([(*p, "k", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(df).collect()}
    assert got == brute(pages) and judge(df).count() == len(pages)
    assert judge(df.limit(0)).count() == 0


def test_ranks_settle_along_a_chain(spark):
    """Forty hosts in a row and back to the third: exact personalised ranks by a linear solve."""
    n, d = 40, 0.85
    ahead = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 2)]
    links = spark.createDataFrame([(f"h{a}", f"h{b}", 1) for a, b in ahead], "src string, dst string, w long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h30", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(links, seeds).collect()}
    m, b = np.zeros((n, n)), np.zeros((n, n))
    for x, y in ahead:
        m[y, x] = 1
        b[x, y] = 1 / sum(v == y for _, v in ahead)
    good, bad = np.eye(n)[0], np.eye(n)[30]
    m += np.outer(good, 1 - m.sum(0))
    b += np.outer(bad, 1 - b.sum(0))
    trust, distrust = (np.linalg.solve(np.eye(n) - d * x, (1 - d) * s) for x, s in ((m, good), (b, bad)))
    assert trust[20] > 0 and all(got[f"h{i}"] == pytest.approx((trust[i], distrust[i]), abs=2e-6) for i in range(n))


def test_links_and_urls_lower_the_same_letters(spark):
    pages = [(1, "http://example.com/en/7", '<a href="http://\u00dc.IO/">x</a>'), (2, "http://\u00dc.io/a", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.trust > 0 for r in judge(df).collect()} == {1: True, 2: True}


@pytest.mark.parametrize("links", [False, True])
def test_sql_agrees(spark, sf, links):
    con = duckdb.connect()
    if links:
        import pandas as pd

        pages = pd.DataFrame(made(), columns=["page_id", "url", "html"])
        con.register("pages", pages)
        want = set(con.execute(op1_urls.SQL).fetchall())
        assert {r[1:] for r in want} == {r[1:] for r in brute(made())}
    else:
        con.execute(f"create view pages as from '{sf}/pages.parquet'")
        assert sorted(con.execute(op1_urls.SQL).fetchall()) == sorted(map(tuple, op1_urls.op1_urls(spark, sf).collect()))
