"""Language-model scoring with a Brown class bigram model.

p(w | v) = p(class(w) | class(v)) * p(w | class(w)). Words with at least 2**-22 of all
training tokens (at most 4,194,304 of them, whatever the corpus) and LEAST occurrences are
dealt into classes by exchange: round after round each word moves to the class that has most pull on it, the sum
over its neighbours of the log association of their classes with that class, held fixed
within a round; half the words move in a round, so that two neighbours don't chase each
other. This is a first-order form of the exchange step: a word's own share in the class
counts is not taken out before it moves. Rounds go on until the mutual information of
neighbouring classes gains less than a tolerance; the classes of the best round count.
Rarer words share one class, whose emission is each word's own smoothed count; the end token
is a class of its own.

Counts cover all training documents and stay in tables: bigrams of the clustered words are one
table, the vocabulary another. Tasks hold the counts of the clustered words; rarer words of a
document are joined to the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, hashed_words, materialize, release, table, texts

CLUSTERED = 2.0**-22
#: Words with fewer occurrences have too little evidence for a class.
LEAST = 8
CLASSES = 64
#: Exchange ends when a pair of rounds gains less than this mutual information (nats).
TOLERANCE = 2e-3
#: Stands for the end of a text among word hashes.
END = np.uint64(0x9D39247E33776D41)


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 1


def token_hashes(text: bytes) -> np.ndarray:
    return np.append(hashed_words(text), END)


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches):
        parts, size = [], 0

        def merged():
            h = np.concatenate([p[0] for p in parts])
            c = np.concatenate([p[1] for p in parts])
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, c, len(u)).astype(np.int64)

        for b in chunks(batches, limit=8 << 20):
            parts.append(np.unique(np.concatenate([token_hashes(t) for t in texts(b)]), return_counts=True))
            size += len(parts[-1][0])
            if size > 3_000_000:
                u, c = merged()
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])
                parts, size = [], 0
        if parts:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Heads:
    """Sorted hashes of frequent words with their counts; index of each clustered one."""

    def __init__(self, h: np.ndarray, c: np.ndarray, least: float):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        big = (self.c >= least) & (self.h != END)
        self.n = int(big.sum())
        self.index = np.full(len(h) + 1, self.n + 1, np.int32)  # n: the end, n + 1: others
        self.index[:-1][big] = np.arange(self.n)
        self.index[:-1][self.h == END] = self.n

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token in h, or len(h)."""
        if not len(self.h):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.h, tokens), len(self.h) - 1)
        return np.where(self.h[at] == tokens, at, len(self.h))


def _bigrams(docs: DataFrame, heads) -> DataFrame:
    def run(batches):
        x = heads.value
        width = x.n + 2
        parts, size = [], 0
        for last in (False, True):
            for b in chunks(batches, limit=8 << 20) if not last else ():
                ids = [x.index[x.find(token_hashes(t))] for t in texts(b)]
                prev = np.concatenate([np.concatenate([[x.n], i[:-1]]) for i in ids]).astype(np.int64)
                parts.append(np.unique(prev * width + np.concatenate(ids), return_counts=True))
                size += len(parts[-1][0])
                if size > 3_000_000:
                    yield from merged(parts, width)
                    parts, size = [], 0
        if parts:
            yield from merged(parts, width)

    def merged(parts, width):
        u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(back, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((u // width).astype(np.int32)), pa.array((u % width).astype(np.int32)), pa.array(c)], names=["v", "w", "c"])

    return docs.select("text").mapInArrow(run, "v int, w int, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))


def class_matrix(pairs: DataFrame, classes, k: int) -> np.ndarray:
    """Counts of class bigrams: at most k * k rows come back."""

    def run(batches):
        m = np.zeros((k, k), np.int64)
        for b in batches:
            v, w = classes.value[b.column(0).to_numpy()], classes.value[b.column(1).to_numpy()]
            m += np.bincount(v.astype(np.int64) * k + w, b.column(2).to_numpy(), k * k).astype(np.int64).reshape(k, k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m.ravel()[at])], names=["at", "c"])

    return _gathered(pairs.mapInArrow(run, "at long, c long"), k)


def association(m: np.ndarray) -> np.ndarray:
    """log of p(c, d) / (p(c) p(d)), smoothed towards independence."""
    total = max(m.sum(), 1)
    expected = np.outer(m.sum(1), m.sum(0)) / total
    return np.log((m + 0.5 * expected / max(expected.mean(), 1e-9) + 1e-3) / (expected + 0.5 * expected / max(expected.mean(), 1e-9) + 1e-3))


def information(m: np.ndarray) -> float:
    """Mutual information of neighbouring classes, from their bigram counts."""
    p = m / max(m.sum(), 1)
    at = p > 0
    return float((p[at] * np.log(p[at] / np.outer(p.sum(1), p.sum(0))[at])).sum())


def exchange(pairs: DataFrame, n: int, k: int = CLASSES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Class of words 0..n-1 (by exchange), of the end (k) and of all others (k + 1), and the
    counts of their bigrams.

    pairs: v, w, c. Rows meet by word once; then each round reads them twice without a
    shuffle of words: class bigrams are counted, and the best class of each word comes back."""
    spark = pairs.sparkSession
    classes = np.concatenate([np.arange(n) % k, [k, k + 1]]).astype(np.int32)
    if n <= 1:
        return classes, class_matrix(pairs, spark.sparkContext.broadcast(classes), k + 2)
    around = materialize(_contexts(pairs), "contexts")
    turn, best_so_far, last = 0, (float("-inf"), classes, None), float("-inf")
    while True:
        now = spark.sparkContext.broadcast(classes)
        m = _matrix(around, now, k + 2)
        gained = information(m)
        if gained > best_so_far[0]:
            best_so_far = (gained, classes, m)
        if turn % 2 == 0:  # each word has had its turn
            if gained < last + tolerance:
                release(around)
                return best_so_far[1:]
            last = gained
        pull = spark.sparkContext.broadcast(association(m))

        def best(batches, now=now, pull=pull):
            for b in batches:
                for part in _slices(b):
                    size = part.num_rows * (k + 2)
                    x, y = (np.bincount(row * (k + 2) + now.value[other], c, size).reshape(-1, k + 2) for row, other, c in (_side(part, 1), _side(part, 3)))
                    cl = (x @ pull.value + y @ pull.value.T)[:, :k].argmax(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cl.astype(np.int32))], names=["w", "cl"])

        new = classes.copy()
        moved = around.filter(F.col("w") < n).mapInArrow(best, "w int, cl int").toArrow()  # two numbers a clustered word
        w, cl = moved.column("w").to_numpy(), moved.column("cl").to_numpy()
        mine = (w.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(2) == turn % 2
        new[w[mine]] = cl[mine]
        now.unpersist()
        pull.unpersist()
        classes, turn = new, turn + 1


def _contexts(pairs: DataFrame) -> DataFrame:
    """For every word the words before it and those after it, with their counts, as bytes of
    int32 and int64: rounds read them as they are, and Spark turns no number into an object."""
    left = pairs.select("w", F.col("v").alias("o1"), F.col("c").alias("c1"), F.lit(None).cast("int").alias("o2"), F.lit(None).cast("long").alias("c2"))
    right = pairs.select(F.col("v").alias("w"), F.lit(None).cast("int").alias("o1"), F.lit(None).cast("long").alias("c1"), F.col("w").alias("o2"), F.col("c").alias("c2"))
    # A word has at most as many words before it as there are clustered ones and two, and so after it.
    lists = left.unionByName(right).groupBy("w").agg(*(F.collect_list(c).alias(c) for c in ("o1", "c1", "o2", "c2")))

    def run(batches):
        for b in batches:
            cut = []
            for i, kind in ((1, np.int32), (2, np.int64), (3, np.int32), (4, np.int64)):
                ends = b.column(i).offsets.to_numpy()
                flat = b.column(i).values.to_numpy()
                cut.append(pa.array([flat[x:y].astype(kind, copy=False).tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cut], names=["w", "before", "n_before", "after", "n_after"])

    return lists.mapInArrow(run, "w int, before binary, n_before binary, after binary, n_after binary")


def _slices(b: pa.RecordBatch):
    """Parts of contexts of about a million neighbours; a longer row is a part of its own."""
    size = sum(pc.binary_length(b.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, b.num_columns, 2))
    ends, i = np.cumsum(size) // 4, 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000, "right")))
        yield b.slice(i, j - i)
        i = j


def _side(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and count of everything in columns i and i + 1."""
    others = b.column(i).to_pylist()
    row = np.repeat(np.arange(len(others)), [len(x) >> 2 for x in others])
    return row, np.frombuffer(b"".join(others), np.int32), np.frombuffer(b"".join(b.column(i + 1).to_pylist()), np.int64)


def _matrix(around: DataFrame, classes, k: int) -> np.ndarray:
    """``class_matrix`` of the pairs in contexts."""

    def run(batches):
        m = np.zeros(k * k, np.int64)
        for b in batches:
            for part in _slices(b):
                row, other, c = _side(part, 1)
                v = classes.value[part.column(0).to_numpy()].astype(np.int64)
                m += np.bincount(v[row] * k + classes.value[other], c, k * k).astype(np.int64)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], names=["at", "c"])

    return _gathered(around.select("w", "after", "n_after").mapInArrow(run, "at long, c long"), k)


def _gathered(parts: DataFrame, k: int) -> np.ndarray:
    m = np.zeros(k * k)
    for r in parts.groupBy("at").agg(F.sum("c").alias("c")).collect():
        m[r["at"]] = r["c"]
    return m.reshape(k, k)


class Model:
    """What tasks need to score: log probabilities of classes, and of words in classes."""

    def __init__(self, heads: Heads, classes: np.ndarray, m: np.ndarray, n: int, v: int):
        k = len(m)
        self.heads, self.n, self.v = heads, n, v
        self.classes = classes[heads.index]
        unigram = (m.sum(0) + 0.5) / (m.sum() + 0.5 * k)
        self.log_t = np.log10((m + 5.0 * unigram) / (m.sum(1, keepdims=True) + 5.0))
        mass = np.bincount(self.classes[:-1], heads.c, k)
        rare = k - 1
        self.n_rare, self.v_rare = int(n - mass[:rare].sum()), int(v - (self.classes[:-1] != rare).sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_e = np.where(self.classes[:-1] == rare, np.log10((heads.c + 0.5) / (self.n_rare + 0.5 * (self.v_rare + 1))), np.log10(heads.c / mass[self.classes[:-1]]))
        self.log_b = np.log10((heads.c + 0.5) / (n + 0.5 * (v + 1)))


PARTIAL = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<h: long, m: int>>"


def _partial_scores(docs: DataFrame, model) -> DataFrame:
    item = pa.struct([("h", pa.int64()), ("m", pa.int32())])

    def run(batches):
        x = model.value
        for b in chunks(batches, limit=2 << 20):
            rows, hs, ms, ends = [], [], [], [0]
            for t in texts(b):
                tokens = token_hashes(t)
                at = x.heads.find(tokens)
                cl = x.classes[at]
                score = x.log_t[np.concatenate([cl[-1:], cl[:-1]]), cl].sum()  # a text starts after an end
                seen = at < len(x.heads.h)
                u, m = np.unique(tokens[~seen], return_counts=True)
                hs.append(u.view(np.int64))
                ms.append(m.astype(np.int32))
                ends.append(ends[-1] + len(u))
                rows.append((len(tokens), int(seen.sum()), x.log_b[at[seen]].sum(), score + x.log_e[at[seen]].sum()))
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ms))], fields=list(item)))
            n, known, base, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), tail], names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PARTIAL)


def fit(train: DataFrame, classes: int = CLASSES, tolerance: float = TOLERANCE) -> tuple[DataFrame, Model]:
    """The vocabulary (h, c) of the training texts, and the model."""
    spark = train.sparkSession
    vocabulary = materialize(_counted(train), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    got = vocabulary.filter(F.col("c") >= n * CLUSTERED).toPandas()  # at most 1 / CLUSTERED rows
    heads = Heads(got["h"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64), max(LEAST, n * CLUSTERED))
    pairs = materialize(_bigrams(train, spark.sparkContext.broadcast(heads)), "bigrams")
    found, m = exchange(pairs, heads.n, classes, tolerance)
    release(pairs)
    return vocabulary, Model(heads, found, m, n, v)


def score(docs: DataFrame, held, *, classes: int = CLASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """Base and model log10 probability of every row of docs (doc_id, text).

    held: the column that says which documents are kept from training. A null or empty text
    is its end token alone; all tokens of a very long one are scored. Where classes tie in pull
    the first wins, so reruns agree. Repeated rows each count and are each scored; further
    columns are ignored; no rows give no rows; without training rows every token is unknown.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    vocabulary, model = fit(marked.filter(~F.col("held_out")), classes, tolerance)
    n, v = model.n, model.v
    parts = materialize(_partial_scores(marked, spark.sparkContext.broadcast(model)).withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    rare = vocabulary.filter(F.col("c") < n * CLUSTERED)
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.m").join(rare, "h", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("m")
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("k2"),
        F.sum(times * F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("b2"),
        F.sum(times * F.log10((c + 0.5) / F.lit(max(model.n_rare, 0) + 0.5 * (model.v_rare + 1)))).alias("s2"),
    )
    zero = F.lit(0)
    out = parts.drop("tail").join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k2", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b2", zero)).alias("base_score"), (F.col("score") + F.coalesce("s2", zero)).alias("score"))


def op8_brown(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out())
