import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm.op7_mixing import _ranked, draw, flight, land, mix, op7_mixing, word_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes):
    """Targets by brute force."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, got, total = dict(sizes), {}, 1.5 * sum(sizes.values())
    while left:
        share = (total - sum(got.values())) / sum(w[s] for s in left)
        full = {s for s in left if share * w[s] >= 2 * sizes[s]}
        if not full:
            return got | {s: share * w[s] for s in left}
        for s in full:
            got[s] = 2.0 * left.pop(s)
    return got


def check(rows, docs):
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want = water(sizes)
    source = {d: s for d, s, _ in docs}
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert len(rows) == len(docs)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s] + 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7_mixing(spark, sf).collect()
    check(got, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op7_mixing(spark, sf).collect()))


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    check(draw(odd.select("doc_id", "source", "text"), ["doc_id", "source"]).collect(), docs)
    assert draw(empty.select("doc_id", "source", "text"), ["doc_id", "source"]).count() == 0
    assert mix(odd).columns == odd.columns and mix(empty).count() == 0


def test_rows_without_an_id_spread_over_blocks(spark):
    rows = [(None, "s", f"word {i}") for i in range(400)] + [(5, "s", f"other {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hashes = df.selectExpr("doc_id", "pmod(xxhash64(doc_id, text, 'mix'), 8) as block").distinct().groupBy("doc_id").count().collect()
    assert [r["count"] for r in hashes] == [8, 8]
    assert draw(df, ["doc_id", "source"]).count() == 800


def test_sources_rank_by_code_point(spark):
    names = ["b", "a", "é", None, "Z", "😀", "\uffee"]
    per = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    want = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert [r.source for r in _ranked(per).orderBy("rank").collect()] == want


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r.copies for r in draw(docs.select("doc_id", "source", "text"), ["doc_id", "source"]).collect()}
    got = defaultdict(int)
    for r in mix(docs).collect():
        got[r.doc_id] += 1
    assert max(plan.values()) > 1 and dict(got) == {d: c for d, c in plan.items() if c}


def test_flight_keeps_both_totals():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        size, pi = rng.integers(1, 500, 400).astype(float), np.full(400, rng.uniform(0.05, 0.95))
        p = flight(pi, size, random.Random(seed))
        inside = (p > 0) & (p < 1)
        assert inside.sum() <= 2 and p @ size == pytest.approx(pi @ size) and p.sum() == pytest.approx(pi.sum())
        assert set(np.unique(land(p, size, random.Random(seed)))) <= {0.0, 1.0}


def test_inclusion_is_unbiased():
    size = np.array([5.0, 1, 9, 4, 4, 30, 2, 8])
    hits = sum(land(flight(np.full(8, 0.3), size, random.Random(i)), size, random.Random(-i)) for i in range(4000)) / 4000
    assert np.all(abs(hits - 0.3) < 0.04)


def test_word_counts():
    some = ["a b", "", None, " x", "y ", "\t\n", "é\x0bü z", "tail", "head", " "]
    want = [len(WORD.findall(t or "")) for t in some]
    assert word_counts(pa.array(some)).tolist() == want
    assert word_counts(pa.array(some).slice(3, 5)).tolist() == want[3:8]
    assert word_counts(pa.array(["", ""])).tolist() == [0, 0]
