import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import op3_jaccard as op3
from quern.llm.common import hashed_words, is_marked, marks
from quern.llm.graph import components
from quern.llm.op3_jaccard import bitmap, bitmap_distance, firsts, op3_jaccard, prefix_size, prefixes, similar, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, k, p, q):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(UP))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    index, parent = defaultdict(list), list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in index[x]:
                near[j] += 1
            index[x].append(i)
        for j, c in near.items():
            if q * c >= p * len(s | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = min(low.get(r, float("inf")), d if d is not None else float("inf"))
    return sorted((d if d is not None else -1, len(s), low[find(i)] if low[find(i)] != float("inf") else -1) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op3_jaccard(spark, sf)) == brute(docs, 3, 90, 100)


@pytest.mark.parametrize(("heavy", "bits", "k", "p"), [(64, 1 << 26, 3, 90), (3, 1 << 26, 5, 60), (3, 1 << 16, 2, 80)])
def test_groups_of_near_copies(spark, heavy, bits, k, p):
    """The last has so few marks that the bar rises and light shingles are marked by chance."""
    rng = random.Random(heavy + bits)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "a"), (len(docs) + 3, "A"), (len(docs) + 4, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(similar(df, k=k, p=p, q=100, heavy=heavy, bits=bits)) == brute(docs, k, p, 100)


def test_texts_around_a_shared_passage(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    passage, docs = [rng.choice(vocab) for _ in range(80)], []
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.6:
                w[5:5] = passage
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, " ".join([rng.choice(vocab) for _ in range(rng.randint(3, 30))] + passage)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(similar(df, k=3, p=90, q=100, heavy=4)) == brute(docs, 3, 90, 100)


def test_copies_of_a_distant_copy_join_by_second_hubs(spark, monkeypatch):
    """Near copies of texts that are akin to a hub but not linked with it, with and without rounds."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    base, docs = [rng.choice(vocab) for _ in range(120)], []
    for _ in range(4):
        far = list(base)
        for i in rng.sample(range(len(far)), 4):
            far[i] = rng.choice(vocab)
        for _ in range(30):
            w = list(far)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 3, 90, 100)
    assert got(similar(df, k=3, p=90, q=100, heavy=4)) == want
    monkeypatch.setattr(op3, "TURNS", 0)
    assert got(similar(df, k=3, p=90, q=100, heavy=4)) == want


def test_prefixes_put_marked_shingles_last():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 7, 200)]
    heavy = np.zeros(1 << 20, np.uint8)
    for x in np.concatenate(sets)[::3] & np.uint64(8 * len(heavy) - 1):
        heavy[x >> np.uint64(3)] |= np.uint8(1 << int(x & np.uint64(7)))
    n = np.array([len(s) for s in sets])
    got_ = prefixes(np.arange(3), n, n, np.concatenate(sets), heavy, 80, 100).to_pylist()
    for i, s in enumerate(sets):
        last = is_marked(heavy, s)
        want = np.concatenate([s[~last], s[last]])[: prefix_size(len(s), 80, 100)].view(np.int64).tolist()
        mine = [r for r in got_ if r["node"] == i]
        assert [r["token"] for r in mine] == want and [r["pos"] for r in mine] == list(range(len(want)))


def test_marks_hold_every_value(spark):
    values = [0, -1, 5, 2**62, -(2**63), 2**31 - 1]
    held = marks(spark.createDataFrame([(v,) for v in values], "v long"), 1 << 20)
    assert is_marked(held, np.array(values)).all() and not is_marked(held, np.array([7, 9, 2**33 + 77])).any()
    assert not marks(spark.createDataFrame([], "v long"), 1 << 20).any()


def test_first_rows_of_components(spark):
    t, u = "a b c d e f g h", "x y z u v w q r"
    df = spark.createDataFrame([(5, t), (5, u), (3, t), (None, u), (None, t), (None, ""), (7, None), (5, u)], "doc_id long, text string")
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in firsts(df).collect()) == [-1, 3, 5, 7]


def test_word_hashes_follow_words():
    for text in (b"", b" ", b"a" * 700_000, b"a" * 700_000 + b" b", b"\x1c\x85a b\x0bA", b"Zeb ra " * 200_000, "Ünï ÜNÏ x".encode()):
        words, hashes = text.lower().split(), hashed_words(text).tolist()
        assert len(words) == len(hashes) and len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes, strict=True)))


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(similar(odd)) == brute(docs, 5, 80, 100)
    assert similar(empty).count() == 0


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for n in (5, 800, 5000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n * 9 // 10], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        assert bitmap_distance(bitmap(x), bitmap(y)) <= len(np.setxor1d(x, y))
        assert np.bitwise_count(sketch(x) ^ sketch(y)).sum() <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    rows = {r.node: r.component for r in components(df).collect()}
    assert all(rows[i] == 0 for i in range(1, 41)) and rows[101] == rows[102] == 100
