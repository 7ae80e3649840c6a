import math
import zlib
from collections import Counter

import numpy as np

from quern.llm.op6_quality import BUCKETS, NEIGHBOURS, Neighbours, classify, fit, held_out, keep_good, op6_quality, terms


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    assert len(rows) == 10000
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good = [rows[r.doc_id].predicted for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].predicted for r in labels if r.quality == 0]
    print("good kept", np.mean(good), "bad kept", np.mean(bad), len(good), len(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_odd_rows(spark, odd, empty, sf):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    got = classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert classify(empty, labels).count() == 0
    assert [r.score for r in classify(odd, labels.limit(0)).collect()] == [0.5] * odd.count()
    assert keep_good(odd, labels).columns == odd.columns


def test_query_by_brute_force(spark):
    """Terms, weights, cosines and votes over a small table, by plain loops; the axes are taken
    from the model and checked for what they must be."""
    rng = np.random.default_rng(6)
    vocab = ["alpha", "beta", "gamma", "delta", "x1", "$$", "THE", "the", "of"]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 30)))) + ("\nagain" * int(rng.integers(0, 3))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [(i, int(rng.integers(0, 2))) for i in range(0, 60, 2)]
    ldf = spark.createDataFrame(labels, "doc_id long, quality int")
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    model = fit(df, ldf.filter(~held_out()).selectExpr("doc_id", "quality as label"))

    def plain(text):
        raw = text.encode()
        n = Counter((a * 961 + b * 31 + c) * 2654435761 % 2**32 >> 20 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False))
        return np.array([min(255, round(16 * math.log2(1 + n[i]))) for i in range(BUCKETS)])

    for t in texts:
        assert (terms(t.encode())[:BUCKETS] == plain(t)).all()
    x = np.stack([terms(texts[i].encode()) for i, _ in learned]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
    assert np.allclose(model.idf, idf, atol=1e-4)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    w = np.stack([unit(r * idf) for r in x])
    assert np.allclose(model.axes.T @ model.axes, np.eye(model.axes.shape[1]), atol=1e-3)
    assert np.linalg.norm(w - w @ model.axes @ model.axes.T) < 1e-2 * np.linalg.norm(w)  # all of so few texts
    y, stand = np.array([v for _, v in learned]), {c: 1.0 for c in (0, 1)}
    points = [unit(r @ model.axes) for r in w]
    for r in classify(df, ldf).collect():
        v = unit(unit(terms(texts[r.doc_id].encode()) * idf) @ model.axes)
        cos = np.array([v @ p for p in points])
        best = np.sort(cos)[::-1]
        if best[NEIGHBOURS - 1] - best[NEIGHBOURS] < 1e-5:
            continue  # a tie within rounding
        at = np.argsort(-cos)[:NEIGHBOURS]
        votes = np.array([np.clip(cos[i], 0, 1) ** 4 * stand[y[i]] for i in at])
        assert abs(r.score - (votes * y[at]).sum() / max(votes.sum(), 1e-9)) < 1e-3, r.doc_id


def test_ties_go_to_the_first_points():
    x = np.zeros((40, 50), np.uint8)
    x[:, 0] = 9
    y = np.array([1] * 20 + [0] * 20)
    m = Neighbours(x, y, np.ones(40), 2)
    assert m.score(x[:3], 20).tolist() == [1.0, 1.0, 1.0]


def test_votes_match_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 99, (60, 300)).astype(np.uint8), rng.integers(0, 2, 60)
    m = Neighbours(x, y, np.ones(60), 8)
    z = rng.integers(0, 99, (5, 300)).astype(np.uint8)
    for row, got in zip(z, m.score(z, 7), strict=True):
        v = row * m.idf @ m.axes
        cos = m.points @ (v / np.linalg.norm(v))
        best = np.argsort(-cos)[:7]
        w = np.clip(cos[best], 0, 1) ** 4 + 1e-9
        assert abs((w * y[best]).sum() / w.sum() - got) < 1e-4
