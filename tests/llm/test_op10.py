import re
from collections import Counter

import numpy as np

from quern.llm.op10_rules import LONGS, STOP, fit, judge, measures, op10_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, hit = Counter(runs), set()
    for i, r in enumerate(runs):
        if many[r] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def check(rows, docs):
    assert len(rows) == len(docs)
    want = Counter((d, *brute(t)) for d, t in docs)
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op10_rules(spark, sf).collect()
    check(got, [(r.doc_id, r.text) for r in docs])
    kept = {r.doc_id: r.kept for r in got if not r.base_failed}
    marks = [(r.quality, kept[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in kept]
    good = [k for q, k in marks if q == 1]
    assert sum(good) / len(good) > 0.97
    bad = [k for q, k in marks if q == 0]
    assert sum(bad) < 0.2 * len(bad)


def test_odd_rows(spark, odd, empty):
    check(judge(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert judge(empty).count() == 0


def test_accuracies_are_found():
    rng = np.random.default_rng(1)
    y, true = rng.random(20000) < 0.7, np.array([0.95, 0.9, 0.8, 0.65])
    votes = np.where(rng.random((20000, 4)) < true, 1, 2)
    votes = np.where(y[:, None], votes, 3 - votes)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    acc, prior, _ = fit(patterns, counts)
    assert abs(prior - 0.7) < 0.03 and np.all(abs(acc.mean(1) - true) < 0.04)


def test_list_marks_count_without_symbols():
    at = LONGS.index("n_marks")
    assert measures(b"- one\n- two\n- three")[at] == 3 and measures(b"- one\n- two\n- three $")[at] == 3
    assert measures(b"| a * b-c")[at] == 2


def test_measures_by_brute_force(spark, sf):
    """The six further measures, by plain loops over characters and lines."""
    space = " \t\n\r\x0b\x0c"
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x.strip(space) for x in text.split("\n") if x.strip(space)]
        upper = sum(any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w) for w in words)
        want = (len(lines), sum(x[-1] in '.!?":;' for x in lines), upper, sum(w.encode() in STOP for w in words), sum(w in "|-*" for w in words), sum(a == b for a, b in zip(words, words[1:], strict=False)))
        assert measures(text.encode())[5:] == want, r.doc_id


def test_posterior_by_brute_force():
    """The posterior from accuracies and prior by Bayes' rule, pattern by pattern."""
    rng = np.random.default_rng(4)
    votes = rng.integers(0, 3, (40, 4))
    acc, prior, post = fit(votes, rng.integers(1, 50, 40), 2000)
    for v, p in zip(votes, post, strict=True):
        good, bad = prior, 1 - prior
        for i, x in enumerate(v):
            if x == 1:
                good, bad = good * acc[i, 0], bad * (1 - acc[i, 1])
            elif x == 2:
                good, bad = good * (1 - acc[i, 0]), bad * acc[i, 1]
        assert abs(good / (good + bad) - p) < 1e-5
