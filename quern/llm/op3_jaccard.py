"""N-gram Jaccard join with set-relation skipping.

Two texts link when their sets of k-word shingles have Jaccard similarity p/q or more. With
s and t the sizes, that is |x delta y| * (q + p) <= (s + t) * (q - p), so all tests are on
symmetric differences, in integers.

1. Texts with equal sets form a class; its first document stands for it.
2. Shingles are put in one global order: by hash, those marked heavy last. A set is indexed
   under the first size - ceil(size * p / q) + 1 shingles of that order; linked sets share one
   of them. Counted are the first parts of all sets, two prefixes long. Where heavy shingles
   leave fewer than a prefix of others there (a set made of shared passages), all its other
   shingles are counted too. The marks are a bitmap of fixed size: any marks give one order
   and so the same links, and a shingle marked by chance only comes later.
3. Every list names as hub the set with the longest lists, which in a group of near copies is
   one with few edits. A set asks the hub that most of its lists name; where less than a
   quarter of both sets differs, the difference is kept as the set's answer and the set is of
   the hub's group. The sets that link with one hub, and it, are a cluster.
4. Index-level skipping: within a list only members outside its largest group look for
   partners of other groups, and only in the list's blocks of matching size and position:
   blocks whose sizes or positions alone put their sets too far apart are never joined, and
   entries carry a small parity sketch of their sets. First those members ask one of
   the largest group, so that copies with two hubs become a cluster, which doesn't meet itself.
5. Answer-level skipping: within a group, |x delta y| = |(x delta hub) delta (y delta hub)|.
   So x and y link only if their answers share an element, or if both link with the hub:
   |x delta hub| + |y delta hub| <= (s + t) * (q - p) / (q + p), with ||y| - |hub|| at most
   |y delta hub|, gives |x delta hub| <= (s + |hub|) * (q - p) / (q + p). An index of the
   answers, rarest elements first, finds the former under as many elements as linked sets
   may differ in and one more. In each of its lists those outside the largest cluster ask
   one of them, a second hub, and its links are of its cluster; so copies of a copy join by
   their hub and not by pairs. Only then do clusters meet in pairs, behind a parity sketch of the
   answers, and links are derived from answers alone, without texts.
   All other pairs pass a parity bitmap, whose Hamming distance never exceeds |x delta y|,
   and are compared in full.
6. Links of hubs and pairs give components.

Shingles are 64-bit hashes of words' 64-bit hashes. A list's length is never capped: hot
lists are ordinary shuffled rows that Spark may split. Texts are read again only for sets
that are to be compared or counted whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import MARKS, chunks, hashed_words, is_marked, marks, materialize, release, shingle_hashes, table, texts, unpacked
from quern.llm.graph import components

HEAVY = 16
#: 64-bit words of an answer's sketch.
SKETCH = 4
#: Rounds of second hubs within groups; what they leave is joined in pairs.
TURNS = 1


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(hashed_words(text), k))


def prefix_size(n: int, p: int, q: int) -> int:
    return n - -(-n * p // q) + 1 if n else 0


def far(s, t, p: int, q: int):
    """Largest symmetric difference of linked sets of these sizes."""
    return (s + t) * (q - p) // (q + p)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the counts of shingles by hash; at least half a bit a shingle."""
    bits = max(512, 1 << int(len(shingles) // 2).bit_length())
    at = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Size, identity, bitmap and first part of every row's set."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("bits", pa.binary()), ("first", pa.list_(pa.int64()))])

    def run(batches):
        for b in chunks(batches, "text"):
            sets = [shingle_set(t, k) for t in texts(b)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            first = [s[: 2 * prefix_size(len(s), p, q)].view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else [], pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            fold = np.array([sketch(s, 2) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(fold[:, 0]), pa.array(fold[:, 1]), pa.array([bitmap(s) for s in sets], pa.binary()), lists], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, k1 long, k2 long, f0 long, f1 long, bits binary, first array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z) of the wanted (node, doc_id, th): only their packed texts are shuffled, and
    those of a few rows that share a mark with them."""
    wanted = wanted.withColumn("mark", F.xxhash64("doc_id", "th"))
    held = docs.sparkSession.sparkContext.broadcast(marks(wanted.select("mark")))

    def run(batches):
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(is_marked(held.value, b.column(0).to_numpy())))
            for c in chunks([b]):
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), pa.array([tool.compress(t) for t in texts(c)], pa.binary())], names=["mark", "d", "t", "z"])

    here = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").select(F.xxhash64("doc_id", "th").alias("mark"), F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    found = here.mapInArrow(run, "mark long, d long, t long, z binary").join(wanted, "mark").filter(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    return found.groupBy("node").agg(F.min("z").alias("z"))  # a row repeated whole is found twice


def _lens(column) -> np.ndarray:
    return np.asarray(column.value_lengths()).astype(np.int64)


def _short(classes: DataFrame, heavy, p: int, q: int) -> DataFrame:
    """(node, doc_id, th) of classes whose first part has fewer than a prefix of light shingles
    and isn't the whole set."""

    def run(batches):
        for b in batches:
            n, size = _lens(b.column(4)), b.column(3).to_numpy()
            light = np.concatenate([[0], np.cumsum(~is_marked(heavy.value, b.column(4).flatten().to_numpy()))])
            ends = np.cumsum(n)
            need = np.array([prefix_size(int(s), p, q) for s in size], np.int64)
            keep = (n < size) & (light[ends] - light[ends - n] < need)
            yield b.select(["node", "doc_id", "th"]).filter(pa.array(keep, pa.bool_()))

    return classes.select("node", "doc_id", "th", "size", "first").mapInArrow(run, "node long, doc_id long, th long")


def _rest(held: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The shingles after the first part of every text (node, z)."""

    def run(batches):
        for b in chunks(batches, "z", 1 << 20):
            sets = [shingle_set(t, k) for t in unpacked(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[2 * prefix_size(len(s), p, q) :] for s in sets]).view(np.int64))], names=["token"])

    return held.select("node", "z").mapInArrow(run, "token long")


ENTRY = "token long, node long, size int, pos int"


def prefixes(node: np.ndarray, size: np.ndarray, n: np.ndarray, flat: np.ndarray, heavy: np.ndarray, p: int, q: int) -> pa.RecordBatch:
    """Index entries of sets given as n shingles each of flat, in hash order."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(row * 2 + is_marked(heavy, flat), kind="stable")
    row = row[order]
    pos = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    need = np.array([prefix_size(int(s), p, q) for s in size], np.int64)
    keep = pos < need[row]
    row = row[keep]
    return pa.RecordBatch.from_arrays([pa.array(flat[order][keep].view(np.int64)), pa.array(node[row]), pa.array(size[row].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "node", "size", "pos"])


def _entries(classes: DataFrame, heavy, p: int, q: int) -> DataFrame:
    """Index entries of classes whose first part holds their prefix."""

    def run(batches):
        for b in batches:
            yield prefixes(b.column(0).to_numpy(), b.column(1).to_numpy(), _lens(b.column(2)), b.column(2).flatten().to_numpy(), heavy.value, p, q)

    return classes.select("node", "size", "first").mapInArrow(run, ENTRY)


def _whole_entries(held: DataFrame, heavy, k: int, p: int, q: int) -> DataFrame:
    """Index entries of whole texts (node, z)."""

    def run(batches):
        for b in chunks(batches, "z", 1 << 20):
            sets = [shingle_set(t, k) for t in unpacked(b)]
            n = np.array([len(s) for s in sets], np.int64)
            yield prefixes(b.column(0).to_numpy(), n, n, np.concatenate(sets), heavy.value, p, q)

    return held.select("node", "z").mapInArrow(run, ENTRY)


def _index(docs: DataFrame, classes: DataFrame, k: int, p: int, q: int, most: int, bits: int) -> DataFrame:
    """The entries of all classes, heavy shingles last.

    At most bits / 8 shingles are marked: where more have over ``most`` sets, the bar doubles.
    That keeps the marks of use and changes the order alone."""
    spark = docs.sparkSession

    def marked(tokens: DataFrame, name: str) -> np.ndarray:
        counts = materialize(tokens.groupBy("token").count().filter(F.col("count") > most), name)
        bar = most
        while counts.filter(F.col("count") > bar).count() > bits // 8:
            bar *= 2
        found = marks(counts.filter(F.col("count") > bar).select("token"), bits)
        release(counts)
        return found

    heavy = marked(classes.select(F.explode("first").alias("token")), "heavy")
    sent = spark.sparkContext.broadcast(heavy)
    short = materialize(_short(classes, sent, p, q), "short")
    held = materialize(_texts_of(docs, short), "short-texts")
    both = spark.sparkContext.broadcast(heavy | marked(_rest(held, k, p, q), "heavy-rest"))
    release(held, short)
    short = materialize(_short(classes, both, p, q), "short")
    enough = classes.select("node", "size", "first").join(short.select("node"), "node", "left_anti")
    entries = _entries(enough, both, p, q).unionByName(_whole_entries(_texts_of(docs, short), both, k, p, q))
    entries = materialize(entries, "index")
    release(short)
    return entries


def sketch(elements: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of the counts of elements by hash, as 64-bit words."""
    at = np.bincount((elements & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(words: list[str]):
    """At least how far the sets with these sketches, and those with the same of ``2``, differ."""
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in words), F.lit(0))


def _compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) with ``diff``: the sorted symmetric difference of the two sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = materialize(_texts_of(docs, classes.select("node", "doc_id", "th").join(wanted, "node")), "pair-texts")
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    two = one.join(held.select(F.col("node").alias("b"), "z"), "b")

    def run(batches):
        last = (None, None)
        for b in chunks(batches, "z", 1 << 20):
            diffs = []
            for text_a, text_b in zip(unpacked(b, "za"), unpacked(b), strict=True):
                if last[0] != text_b:
                    last = (text_b, shingle_set(text_b, k))
                diffs.append(np.setxor1d(shingle_set(text_a, k), last[1], assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(diffs, pa.binary())], names=["a", "b", "diff"])

    out = materialize(two.select("a", "b", "za", "z").mapInArrow(run, "a long, b long, diff binary"), "compared")
    release(held)
    return out


def _near(pairs: DataFrame, nodes: DataFrame, most) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a difference of most(sa, sb), with both sizes."""
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"))

    def run(batches):
        for b in batches:
            x, y = b.column(3).to_pylist(), b.column(5).to_pylist()
            s, t = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            keep = [d <= m and bitmap_distance(i, j) <= m for i, j, d, m in zip(x, y, np.abs(s - t), most(s, t), strict=True)]
            yield b.select(["a", "b", "sa", "sb"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ba", "sb", "bb")
    return joined.mapInArrow(run, "a long, b long, sa int, sb int")


def _elements(answers: DataFrame) -> DataFrame:
    """A row for every element of every answer."""

    def run(batches):
        for b in chunks(batches, "diff", 1 << 20):
            tokens = [np.frombuffer(d, np.int64) for d in b.column(2).to_pylist()]
            n = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n)), pa.array(np.concatenate(tokens))], names=["node", "hub", "token"])

    return answers.select("a", "b", "diff").mapInArrow(run, "node long, hub long, token long")


def _told(answers: DataFrame) -> DataFrame:
    """node, hub, size, away (the length of the answer) and sketch of every answer."""

    def run(batches):
        for b in batches:
            diffs = [np.frombuffer(d, np.uint64) for d in b.column(3).to_pylist()]
            words = np.array([sketch(d) for d in diffs], np.int64).reshape(-1, SKETCH)
            away = pa.array([len(d) for d in diffs], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), away, *(pa.array(words[:, i]) for i in range(SKETCH))], names=["node", "hub", "size", "away", *SKETCHES])

    columns = "node long, hub long, size int, away int, " + ", ".join(f"{c} long" for c in SKETCHES)
    return answers.select("a", "b", "sa", "diff").mapInArrow(run, columns)


SKETCHES = [f"w{i}" for i in range(SKETCH)]


def _within_groups(answers: DataFrame, links: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) within groups: those given (to hubs) and those told by the answers' index.
    And (node, cluster) of sets with a hub that they link with; equal clusters are connected."""
    elements = materialize(_elements(answers), "elements")
    often = elements.groupBy("hub", "token").count().filter("count > 1").withColumnRenamed("count", "n")
    often = materialize(often, "often")
    counted = elements.join(often, ["hub", "token"], "left")
    # at most as many elements as the two texts have shingles
    each = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("all"))
    most = F.expr(f"cast((size + size * {q} div {p}) * {q - p} div {q + p} as int)")
    place = ["hub", "node", "size", "away", *SKETCHES]
    index = each.join(_told(answers), "node").select(*place, F.posexplode(F.slice("all", 1, most + 1)).alias("pos", "e"))
    index = materialize(index.filter("e.n > 1").select(*place, "e.token", "pos"), "answer-index")
    release(elements, often)
    limit = F.expr(f"(size + size2) * {q - p} div {q + p}")
    fits = (F.col("cluster") != F.col("cluster2")) & (F.col("pos") + F.col("pos2") <= limit) & (F.abs(F.col("size") - F.col("size2")) <= limit) & (F.abs(F.col("away") - F.col("away2")) <= limit) & (_apart(SKETCHES) <= limit)

    def told(pairs: DataFrame) -> DataFrame:
        left = answers.select("a", "sa", F.col("diff").alias("da"))
        right = answers.select(F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("diff").alias("db"))
        return materialize(_derive(pairs.join(left, "a").join(right, "b"), p, q), "told-links")

    found = [links]
    label = links.select(F.col("a").alias("node"), F.col("b").alias("cluster"))  # a set asks one hub
    for turn in range(TURNS + 1):
        here = index.join(label, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        sizes = here.groupBy("hub", "token", "cluster").count()
        main = sizes.groupBy("hub", "token").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        probes = materialize(here.join(main, ["hub", "token"]).filter("cluster <> main"), "answer-probes")
        lists = here.select("hub", "token", *(F.col(c).alias(c + "2") for c in ("pos", "node", "size", "away", "cluster", *SKETCHES)))
        if turn < TURNS:
            # the second hub of a list: the one of its probes that is nearest to the hub
            second = probes.groupBy("hub", "token").agg(F.min_by("node", F.struct("away", F.xxhash64("node"), "node")).alias("node2"))
            asked = probes.join(second, ["hub", "token"]).join(lists, ["hub", "token", "node2"]).filter(fits)
            asked = asked.groupBy("node", "node2").count().groupBy("node").agg(F.max_by("node2", F.struct("count", "node2")).alias("node2"))
            found.append(told(asked.select(F.col("node").alias("a"), F.col("node2").alias("b"))))
            new = found[-1].select(F.col("a").alias("node"), F.col("b").alias("second"))
            label = label.join(new, "node", "full").select("node", F.coalesce("second", "cluster").alias("cluster"))
        else:
            once = (F.col("cluster2") == F.col("main")) | (F.col("node") < F.col("node2"))
            pairs = probes.join(lists, ["hub", "token"]).filter(fits & once)
            found.append(told(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()))
        release(probes)
    release(index)
    return reduce(DataFrame.unionByName, found), label


def _derive(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """Links among pairs with sizes and answers for the same hub."""

    def run(batches):
        for b in batches:
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            limit = far(b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), p, q)
            keep = [len(np.setxor1d(np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64), assume_unique=True)) <= m for i, j, m in zip(x, y, limit, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb", "da", "db").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, *, k: int = 5, p: int = 80, q: int = 100, heavy: int = HEAVY, bits: int = MARKS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, a null doc_id counting as the
    largest; texts without words (or null) have an empty set and only themselves. Rows that
    repeat a doc_id with another text are documents of their own; rows repeated whole share a
    class. A very long text is a set like any other, its shingles those of the whole text.
    Further columns are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    sets, of_class, labels = _labelled(docs, k, p, q, heavy, bits)
    lowest = materialize(labels.groupBy("component").agg(F.min("doc_id").alias("component_id")), "lowest")
    named = of_class.join(lowest, "component").select("k1", "k2", "component_id")
    out = sets.filter("n_shingles > 0").join(materialize(named, "of-class"), ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def firsts(docs: DataFrame, *, k: int = 5, p: int = 80, q: int = 100, heavy: int = HEAVY, bits: int = MARKS) -> DataFrame:
    """(doc_id, th) of the row that stands for each component: the first by doc_id (null last),
    then by th, the hash of its text. Rows without words stand for themselves."""
    sets, _, labels = _labelled(docs.select("doc_id", "text"), k, p, q, heavy, bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stand = labels.groupBy("component").agg(F.min(order).alias("r")).select("r.doc_id", "r.th")
    return stand.unionByName(sets.filter("n_shingles = 0").select("doc_id", "th").distinct())


def _labelled(docs: DataFrame, k: int, p: int, q: int, heavy: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets, each class's component, and the same with the class's first row."""
    first = materialize(_sets(docs, k, p, q), "sets")
    sets = materialize(first.drop("first", "bits", "f0", "f1"), "set-keys")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    one = first.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(order).alias("r"), F.first("n_shingles").alias("size"), *(F.first(c).alias(c) for c in ("f0", "f1", "bits", "first")))
    classes = one.select("k1", "k2", "r.doc_id", "r.th", "size", "f0", "f1", "bits", "first").withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    release(first)
    nodes = classes.select("node", F.col("size").cast("int").alias("size"), "bits")

    flat = _index(docs, classes, k, p, q, heavy, bits)
    lists = materialize(flat.groupBy("token").count().filter("count > 1"), "lists")
    live = materialize(flat.join(lists, "token"), "live")
    release(lists, flat)

    def linkable(s, t):
        return far(s, t, p, q)

    def akin(s, t):
        return np.maximum(far(s, t, p, q), (s + t) // 4)

    weights = materialize(live.groupBy("node").agg(F.avg("count").alias("weight")), "weights")
    size = F.expr("length(diff) div 8")
    reach = F.expr(f"greatest((sa + sb) * {q - p} div {q + p}, (sa + sb) div 4)")
    linked = size * F.lit(q + p) <= (F.col("sa") + F.col("sb")) * F.lit(q - p)
    rank = F.struct("weight", F.xxhash64("node"))
    hubs = live.select("token", "node").join(weights, "node").groupBy("token").agg(F.max_by("node", rank).alias("hub"))
    votes = live.join(materialize(hubs, "hubs"), "token").filter("node <> hub").groupBy("node", "hub").count()
    chosen = votes.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("h"))).alias("m")).select(F.col("node").alias("a"), (-F.col("m.h")).alias("b"))
    asked = materialize(_near(chosen, nodes, akin), "hub-pairs")
    compared = _compare(asked.select("a", "b"), docs, classes, k)
    answers = asked.join(compared, ["a", "b"]).filter(size <= reach).withColumn("linked", linked)
    answers = materialize(answers, "answers")
    release(weights, compared)

    links, _ = _within_groups(answers, answers.filter("linked").select("a", "b"), p, q)
    # A cluster is a component of the links so far.
    cluster = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "cluster")
    group = answers.select(F.col("a").alias("node"), F.col("b").alias("group"))
    folds = classes.select("node", "f0", "f1")
    marked = live.drop("count").join(folds, "node").join(cluster, "node", "left").join(group, "node", "left")
    marked = marked.withColumn("cluster", F.coalesce("cluster", "node")).withColumn("group", F.coalesce("group", "node"))
    marked = materialize(marked, "marked")
    release(live)
    sizes = marked.groupBy("token", "group").count()
    main = sizes.groupBy("token").agg(F.max_by("group", F.struct("count", "group")).alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    probes = materialize(marked.join(main, "token").filter("group <> main"), "probes")
    limit = F.floor((F.col("size") + F.col("size2")) * F.lit(q - p) / F.lit(q + p))
    fits = (F.col("group") != F.col("group2")) & (F.col("cluster") != F.col("cluster2")) & (F.col("pos") + F.col("pos2") <= limit) & (F.abs(F.col("size") - F.col("size2")) <= limit) & (_apart(["f0", "f1"]) <= limit)
    # Those outside a list's largest group ask one member of that group first: where a group of
    # copies has two hubs, its parts then are of one cluster, and don't meet in pairs.
    ones = marked.select("token", *(F.col(c).alias(c + "2") for c in ("node", "size", "pos", "cluster", "group", "f0", "f1")))
    second = marked.select("token", "node", "group").join(main, "token").filter(F.col("group") == F.col("main")).groupBy("token").agg(F.min_by("node", F.xxhash64("node")).alias("node2"))
    asked = probes.join(second, "token").join(ones, ["token", "node2"]).filter(fits)
    asked = asked.groupBy("node", "node2", "cluster2").count().groupBy("node").agg(F.max_by(F.struct("node2", "cluster2"), F.struct("count", "node2")).alias("m"))
    asked = materialize(asked.select(F.col("node").alias("a"), F.col("m.node2").alias("b"), F.col("m.cluster2").alias("c")), "second-pairs")
    near = materialize(_near(asked.select("a", "b"), nodes, linkable), "second-near")
    more = near.join(_compare(near.select("a", "b"), docs, classes, k), ["a", "b"]).filter(linked).select("a", "b")
    more = materialize(more.join(asked, ["a", "b"]), "second-links")
    moved = more.select(F.col("a").alias("node"), F.col("c").alias("second"))
    links = links.unionByName(more.select("a", "b"))
    newly = lambda rows: rows.join(moved, "node", "left").withColumn("cluster", F.coalesce("second", "cluster")).drop("second")
    probes, marked = newly(probes), newly(marked)
    width = float(np.log(q / p)) if p < q else 1.0
    block = F.floor(F.log("size") / F.lit(max(width, 1e-6))).cast("int")
    # Two places add up to no more than linked sets may differ in, so one is in a first half:
    # of the most that a set may differ from a linked one.
    late = (F.col("pos") * 2 > F.expr(f"(size + size * {q} div {p}) * {q - p} div {q + p}")).cast("int")
    # Linked sizes differ by a factor of q/p at most: the same block or the next on either side.
    left = probes.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).withColumn("late", F.explode(F.when(late == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    right = marked.withColumn("block", block).select("token", "block", late.alias("late"), F.col("node").alias("node2"), F.col("size").alias("size2"), F.col("pos").alias("pos2"), F.col("cluster").alias("cluster2"), F.col("group").alias("group2"), F.col("f0").alias("f02"), F.col("f1").alias("f12"))
    fits &= (F.col("group2") == F.col("main")) | (F.col("node") < F.col("node2"))
    pairs = left.join(right, ["token", "block", "late"]).filter(fits)
    pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    rest = materialize(_near(pairs, nodes, linkable), "near-pairs")
    full = rest.join(_compare(rest.select("a", "b"), docs, classes, k), ["a", "b"]).filter(linked).select("a", "b")
    links = materialize(links.unionByName(full), "all-links")
    release(pairs, rest, answers)
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = classes.select("k1", "k2", "doc_id", "th", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = materialize(labels.select("k1", "k2", "doc_id", "th", "component"), "labels")
    release(classes)
    return sets, labels.select("k1", "k2", "component"), labels


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, p=90, q=100)
