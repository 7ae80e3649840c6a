"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is met by whole copies of every document and one fractional part f: each
document is taken floor(rate) times and once more with probability f. The cube method makes
these draws: within a block of one source's documents it moves the vector of inclusion
probabilities along directions in the null space of the balancing constraints (tokens and
documents), until at most two probabilities of the block are fractional. What is left of a
thousand blocks forms a block of the next level, and so on; the last block of a source leaves
a landing problem of two documents, which a small linear program settles. A source is cut
into blocks by document hash, so a source with most of the rows is many equal blocks, and
only undecided documents travel to later levels.

``documents`` rows are sized by words; a null text has none. Ties and repeated rows are drawn
each on its own. Null sources form one source, after all others. Draws depend on doc_id, text
and source alone, so reruns and other partitionings agree: rows that tie in size, id and text
are the same row. An empty text has size 0 and is taken like others; of a very long one all
words count. Extra columns of any name come back as they are; no rows give no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, materialize, release, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 2048
FAN_IN = 512


def word_counts(col) -> np.ndarray:
    """Words of each text of an Arrow string array, counted over its bytes at once."""
    kind = pa.large_string() if len(col) else pa.string()
    col = col.cast(kind)
    n = len(col)
    out = np.zeros(n, np.int64)
    if not n or col.buffers()[2] is None:
        return out
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = np.ones(len(raw) + 1, bool)
    word[:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = word[:-1].copy()
    first[1:] &= ~word[:-2]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    first[inner] = word[inner]  # a text's first byte starts a word whatever stands before
    total = np.concatenate([[0], np.cumsum(first)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs' columns, with ``mix_words`` in place of text."""
    from pyspark.sql.types import LongType, StructField, StructType

    # an array, not a scan of Python strings: 1 GB of text takes a second or two
    fields = [docs.schema[c] for c in columns]
    schema = StructType([*fields, StructField("mix_words", LongType())])

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(word_counts(b.column(len(columns))), pa.int64())], names=[*columns, "mix_words"])

    return docs.select(*columns, F.col("text").alias("mix_text")).mapInArrow(run, schema)


def _ranked(per: DataFrame) -> DataFrame:
    """per with ``rank`` from 0 by source (null last): places in the tasks of a range sort, and
    one count a task."""
    spark = per.sparkSession
    placed = materialize(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-ranks")
    part = F.shiftright("at", 33)
    offsets, before = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a task
        offsets.append((r["part"], before))
        before += r["count"]
    known = spark.createDataFrame(offsets, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(known), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size, n, target: shares by weight, none above ``most`` times its size.

    Works on one row per source; each pass of the refill is one aggregate over those rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = _ranked(per)
    rank = F.col("rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = materialize(per.withColumn("weight", weight).drop("rank").withColumn("most", F.lit(float(most)) * F.col("source_size")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:  # ends when a pass caps no further source
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level)
        row = per.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            level = float("inf")
            break
        now = (share * total - (row[0] or 0.0)) / row[1]
        if level is not None and now <= level * (1 + 1e-12):
            break
        level = now
    target = F.col("most") if level == float("inf") else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "n", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping sum(size * pi) and sum(pi); leaves <= 2 inside."""
    p, s = pi.tolist(), size.tolist()
    live: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, x in zip(live, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        step = up if rng.random() * (up + down) < down else -down
        keep = []
        for i, x in zip(live, u, strict=True):
            p[i] += step * x
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = float(p[i] > 0.5)
            else:
                keep.append(i)
        live = keep
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Rounds the last two fractions: the design with these inclusion probabilities whose
    expected imbalance of tokens is least."""
    p = pi.copy()
    live = [i for i in range(len(p)) if 0 < p[i] < 1]
    u = rng.random()
    if len(live) == 1:
        p[live[0]] = float(u < p[live[0]])
    elif live:
        i, j = live
        off = lambda x, y: abs((x - p[i]) * size[i] + (y - p[j]) * size[j])
        both = max(0.0, p[i] + p[j] - 1) if off(1, 1) + off(0, 0) > off(1, 0) + off(0, 1) else min(p[i], p[j])
        first, second = p[i] - both, p[j] - both
        p[i], p[j] = (1.0, 1.0) if u < both else (1.0, 0.0) if u < both + first else (0.0, 1.0) if u < both + first + second else (0.0, 0.0)
    return p


def _level(depth: int, last: bool):
    def run(key, group):
        order = [("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")]
        group = group.sort_by(order)
        rng = random.Random(f"{depth}/{key[0].as_py()}/{key[1].as_py()}")
        size = group.column("size").to_numpy().astype(np.float64)
        pi = flight(group.column("pi").to_numpy(), size, rng)
        if last:
            pi = land(pi, size, rng)
        return group.set_column(group.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))

    return run


def cube(docs: DataFrame, copies_of: list[str], level_blocks: list[int]) -> DataFrame:
    """Adds ``drawn`` (0 or 1) to rows with source, size, h, pi and blocks; a level a job."""
    names = [*copies_of, "size", "h", "base", "pi", "blocks", "block"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    done, todo = [], docs.select(*names)
    for depth, blocks in enumerate(level_blocks):
        run = _level(depth, blocks == 1)
        moved = materialize(todo.groupBy("source", "block").applyInArrow(run, schema), "mix-level")
        whole = F.col("pi").isin(0.0, 1.0)
        done.append(moved.filter(whole))
        up = F.pmod(F.col("h"), F.ceil(F.col("blocks") / F.lit(FAN_IN)).cast("long"))
        todo = moved.filter(~whole).withColumn("blocks", F.ceil(F.col("blocks") / F.lit(FAN_IN)).cast("long")).withColumn("block", F.when(F.col("blocks") > 1, up).otherwise(0))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("drawn", F.col("pi").cast("long"))


def draw(docs: DataFrame, columns: list[str], weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per document: ``columns`` (with doc_id and source), size, source_size, target,
    copies, taken."""
    # by id and text: rows without an id, or with the same one, spread over blocks too
    hashed = docs.withColumn("h", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("mix")))
    sizes = materialize(sized(hashed, [*columns, "h"]).withColumnRenamed("mix_words", "size"), "mix-sizes")
    targets = materialize(source_targets(sizes.select("source", "size"), weights, share, most).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")), "mix-targets")
    t = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "t_source")
    joined = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source", "n")
    base = F.floor(F.col("rate") + F.lit(1e-9)).cast("long")
    rows = joined.withColumn("base", base).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).withColumn("block", F.pmod(F.col("h"), F.col("blocks")))
    blocks = targets.agg(F.max("blocks")).first()[0] or 1
    levels = [blocks]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // FAN_IN))
    keep = [*columns, "source_size", "target"]
    out = cube(rows, keep, levels)
    copies = F.col("base") + F.col("drawn")
    return out.select(*keep, "size", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return draw(docs, ["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """docs' rows, each as often as the mix takes it (none, once, ...), with docs' columns."""
    row, copies, copy = fresh(docs.columns, "mix_row", "mix_copies", "mix_copy")
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = draw(marked.select("doc_id", "source", F.col(row).alias("mix_row"), "text"), ["doc_id", "source", "mix_row"], weights, share, most)
    plan = plan.filter("copies > 0").select(F.col("mix_row").alias(row), F.col("copies").alias(copies))
    again = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return marked.join(plan, row).withColumn(copy, again).select(*docs.columns)
