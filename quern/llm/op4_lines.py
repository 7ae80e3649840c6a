"""Line dedup: a deletion-neighbourhood join on words.

A line repeats an earlier one when their words (A-Z lower-cased) are equal or, for lines of
``least`` words or more, differ by one inserted, dropped or replaced word. Every variant
within the bound, a line with one word deleted, is a hashed key; lines with an equal variant
meet under it. Replaced words delete at the same place, so all lines under (place, hash) are
within the bound of each other and of the earliest, which is all that is emitted; a dropped
word makes the one line equal to a variant of the other. Nothing is emitted per pair, and
the edit distance of each line to the earlier one found is verified on the words.

Before variants are emitted for a line, one of its halves must equal that of another line:
with one edit between two lines, all before or all after it is the same. So most lines emit
four keys and not one for each word.

Texts meet the places of their lines by sort-merge join at every size: those places grow
with the corpus, so a small one's plan is that of a large one.

Equal lines are those with equal 128-bit hashes. Lines are ordered by doc_id (null last), then by a hash of the text, then by place. An
earlier line counts even if it goes itself. Lines without words stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, fresh, hashed_words, materialize, mix, packed, release, texts, unpacked
from quern.llm.common import table as read_table

LEAST = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


class Sums:
    """Hashes of runs of words of many lines at once: sums of word hash times a power of the
    place in the line. words: those of all lines in a row; sizes: how many each line has."""

    up, down = _powers(BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __init__(self, words: np.ndarray, sizes=None):
        self.n = np.array([len(words)] if sizes is None else sizes, np.int64)
        most = int(self.n.max(initial=0))
        if most >= len(Sums.up):
            Sums.up, Sums.down = _powers(BASE, 2 * most), _powers(_INVERSE, 2 * most)
        self.stop = np.cumsum(self.n)
        self.start = self.stop - self.n
        self.place = np.arange(len(words)) - np.repeat(self.start, self.n)
        self.s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * Sums.up[self.place])])
        self.words = words

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of every line, the words at places start to stop."""
        return (self.s[self.start + stop] - self.s[self.start + start]) * Sums.down[start]

    def whole(self) -> np.ndarray:
        return mix(self.s[self.stop] - self.s[self.start] + self.n.astype(np.uint64)).view(np.int64)

    def second(self) -> np.ndarray:
        """A hash of the whole line that shares nothing with ``whole`` but the words' hashes."""
        t = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.words ^ _OTHER) * Sums.up[self.place])])
        return mix(t[self.stop] - t[self.start] ^ self.n.astype(np.uint64)).view(np.int64)

    def deletions(self) -> np.ndarray:
        """For every word, the ``whole()`` of its line without it."""
        first, last = (np.repeat(self.s[at], self.n) for at in (self.start, self.stop))
        rest = self.s[:-1] - first + (last - self.s[1:]) * _INVERSE
        return mix(rest + np.repeat(self.n - 1, self.n).astype(np.uint64)).view(np.int64)

    def halves(self) -> np.ndarray:
        """A row a line: first and last part at the cuts of lengths n and n - 1, tagged by
        length and side."""
        out = []
        for n in (self.n, self.n - 1):
            h = n // 2
            for side, x in ((0, self.run(np.zeros_like(h), h)), (1, self.run(self.n - (n - h), self.n))):
                out.append(mix(x ^ mix((n * 2 + side).astype(np.uint64))).view(np.int64))
        return np.stack(out, 1)


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word. Long words can be made to agree in a sum of powers modulo
    2**64, so theirs is another hash."""
    h, starts, ends = hashed_words(text, places=True)
    for i in np.flatnonzero(ends - starts > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]].lower())
    return h, starts


LINES = "doc_id long, th long, line int, h long, h2 long, n int, halves array<long>"


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """Every line with words; ``halves`` of those with ``least`` words or more."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("halves", pa.list_(pa.int64()))])

    def run(batches):
        for b in chunks(batches, limit=2 << 20):
            held = texts(b)
            joined = b"\n".join(held)
            words, starts = _hashed(joined)
            breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
            of, sizes = np.unique(np.searchsorted(breaks, starts), return_counts=True)  # lines with words
            begin = np.cumsum([0, *(t.count(b"\n") + 1 for t in held)])
            rows = np.searchsorted(begin, of, "right") - 1
            lines = of - begin[rows]
            s = Sums(words, sizes)
            long = s.n >= least
            ends = np.concatenate([[0], np.cumsum(long * 4)]).astype(np.int32)
            halves = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.halves()[long].ravel()))
            ids = b.select(["doc_id", "th"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(lines.astype(np.int32)), pa.array(s.whole()), pa.array(s.second()), pa.array(s.n.astype(np.int32)), halves], schema=schema)

    return docs.select("doc_id", "th", "text").mapInArrow(run, LINES)


def _words(held: DataFrame) -> DataFrame:
    """r and words of the wanted lines (column ``wanted``: line, r) of packed texts."""

    def run(batches):
        for b in chunks(batches, "z", 1 << 20):
            rs, ws = [], []
            for wanted, t in zip(b.column(0).to_pylist(), unpacked(b), strict=True):
                lines = t.lower().split(b"\n")
                for w in wanted:
                    rs.append(w["r"])
                    ws.append(b" ".join(lines[w["line"]].split()))
            yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(ws, pa.binary())], names=["r", "words"])

    return held.select("wanted", "z").mapInArrow(run, "r long, words binary")


def _variants(words: DataFrame) -> DataFrame:
    """A row for every word of every line: the line's hash without it, and its place."""

    def run(batches):
        for b in chunks(batches, "words", 256 << 10):
            lines = b.column(1).to_pylist()
            s = Sums(_hashed(b" ".join(lines))[0], [line.count(b" ") + 1 for line in lines])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), s.n)), pa.array(s.deletions()), pa.array(s.place.astype(np.int32))], names=["r", "key", "place"])

    return words.select("r", "words").mapInArrow(run, "r long, key long, place int")


def within_one(x: list, y: list) -> bool:
    """Word edit distance of at most one."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i + 1 :] == y[i:] if len(x) > len(y) else x[i:] == y[i + 1 :]


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, th, drop: places of the lines of docs (doc_id, th, text) that repeat an earlier one."""
    spark = docs.sparkSession
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")
    lines = materialize(_lines(docs, least), "lines")
    distinct = materialize(lines.groupBy("h", "h2").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("copies")), "distinct-lines")
    exact = lines.join(distinct.filter("copies > 1").select("h", "h2", "o"), ["h", "h2"]).filter(order != F.col("o")).select("doc_id", "th", "line")
    exact = materialize(exact, "exact")
    half = lines.filter("halves is not null").select("h", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("half")
    shared = materialize(shared, "halves")
    near = materialize(half.join(shared, "half", "left_semi").select("h").distinct(), "near")
    near = materialize(near.join(distinct, "h").select("h", "h2", "o"), "near-lines")
    # r numbers the near lines in their order, so that it stands for the order from here on
    near = materialize(near.orderBy("o").withColumn("r", F.monotonically_increasing_id()), "ranked-lines")
    release(distinct, shared)
    wanted = near.groupBy(F.col("o.doc_id").alias("wd"), F.col("o.th").alias("wt")).agg(F.collect_list(F.struct("o.line", "r")).alias("wanted"))
    texts_z = packed(docs.select("doc_id", "th", "text"), "doc_id long, th long")
    held = texts_z.join(materialize(wanted, "wanted").hint("merge"), F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt")))
    words = materialize(_words(held), "held-words")
    del held, texts_z, wanted
    words = materialize(words.groupBy("r").agg(F.first("words").alias("words")), "near-words")  # a row repeated whole gives its lines twice
    keys = materialize(_variants(words), "variants")
    # replaced: the earliest line of the same (place, hash); dropped: a whole line among the variants
    best = materialize(keys.groupBy("key", "place").agg(F.min("r").alias("b"), F.max("r").alias("last")).filter("b < last").drop("last"), "keys")
    same = materialize(keys.join(best, ["key", "place"]).filter("b < r").select("r", "b").distinct(), "replaced")
    cut = materialize(keys.join(near.select(F.col("h").alias("key"), F.col("r").alias("w")), "key").select("r", "w").distinct(), "dropped")
    release(keys, best)
    longer = cut.filter("w < r").select("r", F.col("w").alias("b"))
    shorter = cut.filter("r < w").groupBy("w").agg(F.min("r").alias("b")).select(F.col("w").alias("r"), "b")
    found = materialize(same.unionByName(longer).unionByName(shorter).distinct(), "edits")  # at most two a word
    both = found.join(words.withColumnRenamed("words", "x"), "r").join(words.select(F.col("r").alias("b"), F.col("words").alias("y")), "b")
    gone = materialize(_verified(both).distinct().join(near, "r").select("h", "h2"), "gone")
    edited = lines.join(gone, ["h", "h2"], "left_semi").select("doc_id", "th", "line")
    drops = exact.unionByName(edited).groupBy("doc_id", "th").agg(F.array_distinct(F.collect_list("line")).alias("drop"))
    drops = materialize(drops, "drops")
    release(lines, exact, near, words, same, cut, found, gone)
    return drops


def _verified(both: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            x, y = b.column(1).to_pylist(), b.column(2).to_pylist()
            keep = [within_one(i.split(), j.split()) for i, j in zip(x, y, strict=True)]
            yield b.select(["r"]).filter(pa.array(keep, pa.bool_()))

    return both.select("r", "x", "y").mapInArrow(run, "r long")


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with ``line_text``, ``n_lines``, ``n_dropped``: each text without its repeated lines.

    A null text stays null and has no lines; an empty one has one line without words, which
    stays. Of equal lines the first in (doc_id, text hash, place) stays. Rows that repeat a
    doc_id with another text are documents of their own; rows repeated whole are one document
    and are treated alike. A very long text or line is cut at no place: all its words count.
    Further columns pass through, but for those named like a result, which it replaces; no
    rows give no rows.
    """
    return _dedup(docs, least, ("line_text", "n_lines", "n_dropped"))


def _dedup(docs: DataFrame, least: int, results) -> DataFrame:
    th, d, t, drop = fresh([*docs.columns, *results], "line_th", "line_d", "line_t", "line_drop")
    named = docs.withColumn(th, F.xxhash64("text"))
    drops = repeated(named.select("doc_id", F.col(th).alias("th"), "text"), least)
    drops = drops.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("drop").alias(drop))
    joined = named.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left")
    parts = F.split("text", "\n", -1)
    dropped = F.coalesce(drop, F.array().cast("array<int>"))
    # only texts that lose lines are cut up
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    values = (F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept), F.coalesce(F.size(parts), F.lit(0)), F.size(dropped))
    return joined.withColumns(dict(zip(results, values, strict=True))).drop(th, d, t, drop)


def op4_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.md5(F.coalesce("line_text", F.lit(""))).alias("text_md5"))


def drop_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeated lines cut out of text (n_chars follows); a document whose every
    line with words stands in earlier documents goes. All docs' columns come back."""
    columns = docs.columns
    text, n_lines, n_dropped = results = fresh(columns, "line_text", "n_lines", "n_dropped")
    out = _dedup(docs, least, results)
    has_word = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    out = out.filter((F.col(n_dropped) == 0) | has_word).withColumn("text", F.col(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
