"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms are byte trigrams and a few binned shape terms. A bounded sample of labelled texts
(``per_class`` of each label, by hash of doc_id) gives the term weights, the latent axes
(truncated singular value decomposition) and the labelled vectors; all three have fixed
sizes and are broadcast. Every document is then compared with every labelled vector, in
blocks of exact cosine products, and the labels of its ``neighbours`` nearest ones vote,
weighted by similarity and by how many labelled documents each stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, fresh, table, texts

BUCKETS = 4096
SHAPES = 96
TERMS = BUCKETS + SHAPES
AXES = 64
PER_CLASS = 1536
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Documents that are compared with all labelled vectors at once.
BLOCK = 1024


def _bin(share: float) -> int:
    return min(7, int(np.ceil(share * 20) ** 0.7)) if share > 0 else 0


def terms(text: bytes) -> np.ndarray:
    """Term weights of a text as bytes: 16 log2(1 + count), at most 255."""
    out = np.zeros(TERMS, np.float64)
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) > 2:
        code = (raw[:-2] * np.uint32(961) + raw[1:-1] * np.uint32(31) + raw[2:]) * np.uint32(2654435761) >> np.uint32(20)
        out[:BUCKETS] = np.bincount(code, minlength=BUCKETS)[:BUCKETS]
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        sum(map(bytes.__eq__, words[1:], words)) / n,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(words)) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / n if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        len(text.translate(None, b"#*$%&|<>!")) / max(1, len(text)),
        sum(len(w) == 1 for w in words) / n,
    )
    for i, s in enumerate(shares):
        out[BUCKETS + 8 * i + _bin(s)] = 8
    out[BUCKETS + 8 * len(shares) + min(15, len(words).bit_length())] = 4
    return np.minimum(255, np.round(16 * np.log2(1 + out))).astype(np.uint8)


def _term_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([terms(t).tobytes() for t in texts(b)], pa.binary())], names=["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms binary")


class Neighbours:
    """Weights, axes and labelled vectors; all sizes are bounded by the parameters."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stand_for: np.ndarray, axes: int = AXES):
        x = x.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        w = self._unit(x * self.idf)
        rng = np.random.default_rng(0)
        q = rng.standard_normal((w.shape[1], min(axes + 16, w.shape[0]))).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(w.T @ (w @ q))[0]
        _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
        self.axes = (q @ vt.T)[:, :axes].astype(np.float32)
        self.points = self._unit(w @ self.axes)
        self.y, self.weight = y.astype(np.float32), stand_for.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of the votes for label 1 of each row of term weights."""
        near = self._unit((self._unit(x.astype(np.float32) * self.idf)) @ self.axes) @ self.points.T
        k = min(k, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(near, at, 1).min(1, keepdims=True)
        if tied := np.flatnonzero((near >= edge).sum(1) > k).tolist():
            at[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
        w = np.clip(np.take_along_axis(near, at, 1), 0, 1) ** 4 * self.weight[at] + 1e-9
        return np.clip((w * self.y[at]).sum(1) / w.sum(1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Neighbours | None:
    """labels: doc_id, label (0 or 1; others are ignored, the lower one of two counts)."""
    one = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    if not counts:
        return None
    order = (F.xxhash64("doc_id", F.lit("quality")), F.col("doc_id"))
    picked = [one.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in sorted(counts)]
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
    label = chosen.withColumnRenamed("doc_id", "of")
    rows = _term_rows(sample).join(F.broadcast(label), F.col("doc_id") == F.col("of"))
    # of a repeated doc_id's texts the one with the least terms counts, so that reruns agree
    rows = rows.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.min("label").alias("label")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows])
    stand = np.array([counts[c] / max(1, int((y == c).sum())) for c in y])
    return Neighbours(np.stack([np.frombuffer(r["terms"], np.uint8) for r in rows]), y, stand)


def scored(docs: DataFrame, model: Neighbours | None, columns: list[str], name: str = "quality_score") -> DataFrame:
    """docs' ``columns`` and the score as ``name``. Without a model every score is 0.5."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    (text,) = fresh([*columns, name], "quality_text")

    def run(batches):
        for b in chunks(batches, text, 2 << 20, BLOCK):
            rows = [terms(t) for t in texts(b, text)]
            scores = held.value.score(np.stack(rows)) if held.value is not None else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(scores.astype(np.float64))], names=[*columns, name])

    schema = StructType([*(docs.schema[c] for c in columns), StructField(name, DoubleType())])
    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(run, schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    labels: doc_id, quality. Null and empty texts are scored by their shape terms alone; of a
    very long text all trigrams count. Where neighbours tie, the first labelled ones in
    doc_id's order vote. Repeated rows are each scored, alike; of a labelled doc_id with
    several texts one, always the same, is learned from. Further columns are ignored; no rows
    give no rows.
    """
    model = fit(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with docs' columns."""
    model = fit(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))
    (score,) = fresh(docs.columns, "quality_score")
    return scored(docs, model, docs.columns, score).filter(F.col(score) >= THRESHOLD).select(*docs.columns)
