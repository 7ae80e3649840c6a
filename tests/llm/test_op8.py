import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.common import hashed_words
from quern.llm.op8_brown import END, association, _contexts, _matrix, class_matrix, exchange, fit, information, op8_brown, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def check(rows, docs, held):
    tokens = [[*WORD.findall((t or "").translate(UP)), None] for _, t in docs]
    c = Counter(w for (d, _), x in zip(docs, tokens, strict=True) if not held(d) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((d if d is not None else -1, held(d), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)) for (d, _), x in zip(docs, tokens, strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-3)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op8_brown(spark, sf).collect()
    check(rows, docs, lambda d: zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    base, model = sum(r.base_score for r in held), sum(r.score for r in held)
    print("held-out gain", model - base, "of", base)
    assert model > base


def test_odd_rows(spark, odd, empty):
    check(score(odd, F.col("doc_id") == 3).collect(), [(r.doc_id, r.text) for r in odd.collect()], lambda d: d == 3)
    assert score(empty, F.lit(False)).count() == 0


def test_exchange_finds_classes(spark):
    rng = np.random.default_rng(0)
    rows = []  # words 0..9 follow 10..19 and the other way round
    for _ in range(3000):
        a, b = int(rng.integers(10)), 10 + int(rng.integers(10))
        rows += [(a, b, 1), (b, int(rng.integers(10)), 1)]
    pairs = spark.createDataFrame(rows, "v int, w int, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))
    got, m = exchange(pairs, 20, 2)
    assert m.sum() == 6000 and information(m) > 0.6
    assert len(set(got[:10])) == len(set(got[10:20])) == 1 and got[0] != got[10]


def test_scores_by_brute_force(spark):
    """The model's probabilities by counting classes in the texts themselves, and their sum."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 60)) if x < 300) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    _, model = fit(df.filter(~held), 5)
    k = len(model.log_t)
    place = {int(h): i for i, h in enumerate(model.heads.h)}
    ids = [[int(h) for h in hashed_words(t.encode())] + [int(END)] for t in texts]
    train = [x for i, x in enumerate(ids) if i % 4 != 1]
    counts = Counter(h for x in train for h in x)
    assert set(place) == set(counts)
    cl = {h: int(model.classes[i]) for h, i in place.items()}
    assert all((cl[h] == k - 1) == (c < 8) for h, c in counts.items() if h != int(END))
    end = cl[int(END)]
    big = np.zeros((k, k))
    for x in train:
        for a, b in zip([int(END), *x], x, strict=False):
            big[cl[a], cl[b]] += 1
    uni = (big.sum(0) + 0.5) / (big.sum() + 0.5 * k)
    trans = (big + 5 * uni) / (big.sum(1, keepdims=True) + 5)
    assert np.allclose(trans.sum(1), 1)
    mass = Counter()
    for h, c in counts.items():
        mass[cl[h]] += c
    for c in range(k - 1):
        assert sum(counts[h] / mass[c] for h in counts if cl[h] == c) == pytest.approx(1) or not mass[c]
    few = [c for h, c in counts.items() if cl[h] == k - 1]
    rest = lambda c: (c + 0.5) / (sum(few) + 0.5 * (len(few) + 1))
    assert sum(map(rest, few)) + rest(0) == pytest.approx(1)
    got = {r.doc_id: r.score for r in score(df, held, classes=5).collect()}
    for i, x in enumerate(ids):
        want, before = 0.0, end
        for h in x:
            c = cl.get(h, k - 1)
            want += math.log10(trans[before, c] * (counts[h] / mass[c] if c < k - 1 else rest(counts[h])))
            before = c
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_exchange_stops_at_its_best_round(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 30, 500), rng.integers(0, 30, 500), rng.integers(1, 9, 500), strict=True)]
    pairs = spark.createDataFrame(rows, "v int, w int, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))
    found, m = exchange(pairs, 28, 4)
    start = np.concatenate([np.arange(28) % 4, [4, 5]]).astype(np.int32)
    first = class_matrix(pairs, spark.sparkContext.broadcast(start), 6)
    assert information(m) >= information(first) and association(m).shape == (6, 6)
    assert (class_matrix(pairs, spark.sparkContext.broadcast(found), 6) == m).all()


def test_rounds_read_contexts_as_bytes(spark):
    """Rounds read a row a word, whose neighbours are bytes and not rows or lists."""
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 12, 300), rng.integers(0, 12, 300), rng.integers(1, 1 << 33, 300), strict=True)]
    pairs = spark.createDataFrame(rows, "v int, w int, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))
    around = _contexts(pairs)
    assert [f.dataType.simpleString() for f in around.schema] == ["int"] + ["binary"] * 4
    want = {(r.v, r.w): r.c for r in pairs.collect()}
    before, after = {}, {}
    for r in around.collect():
        before |= {(v, r.w): c for v, c in zip(np.frombuffer(r.before, np.int32).tolist(), np.frombuffer(r.n_before, np.int64).tolist(), strict=True)}
        after |= {(r.w, w): c for w, c in zip(np.frombuffer(r.after, np.int32).tolist(), np.frombuffer(r.n_after, np.int64).tolist(), strict=True)}
    assert before == after == want
    classes = spark.sparkContext.broadcast(np.concatenate([np.arange(10) % 3, [3, 4]]).astype(np.int32))
    assert (_matrix(around, classes, 5) == class_matrix(pairs, classes, 5)).all()
