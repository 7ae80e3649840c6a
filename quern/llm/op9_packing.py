"""Lexical retrieval packing: a sharded BM25 index fills each seed's window with neighbours.

Documents are tokenized once, dealt into shards by a hash (a fixed number of documents a
shard, so shards grow in number and not in size), and every shard is one group: it indexes
its documents by token id, takes its first unused document as seed and fills the window
with the unused documents of highest BM25 score for the seed. The document that reaches the
window's end is cut there and its rest seeds the next window, so windows are full. What is
left at a shard's end is cut into sequences whose lengths are powers of two, which need no
padding.

Document frequencies, the number of documents and their mean length are those of the whole
table. A seed still finds neighbours in its own shard alone (README: measured recall).
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, materialize, mix, table, texts, trim

WINDOW = 2048
SHARD_DOCS = 512
END_ID = 1
#: Rows of statistics that are no token id.
COUNT, LENGTH = -1, -2

#: Places of a task's table of short runs, and the most ids that one of them has there.
PLACES, MOST_IDS = 1 << 20, 6
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_GAPS = bytes(1 if b in (32, 9, 10, 11, 12, 13) else 0 for b in range(256))
_ENDS = np.array([b in PUNCTUATION for b in range(256)])
#: The character by which a byte-level tokenizer writes each byte.
_BYTE_CHARS = np.arange(256, dtype="<u4")
_BYTE_CHARS[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
_BYTE_CHARS[32] = 32  # between words
_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


class WordIds:
    """Ids of words as little-endian uint16, for a tokenizer that never joins across white
    space and cuts off a word's final punctuation as a run of its own.

    A word without its final punctuation, and that punctuation, are looked up apart. Runs of
    at most 16 bytes are known by their length and first and last 8 bytes, which are all of
    them, so a table of fixed size finds the ids of many runs at once. Others and those that
    are not in the table are encoded, words of letters many at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok = Tokenizer.from_file(path)
        # the same model without what words of letters, lower-cased and as bytes, don't need
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.table = np.zeros(PLACES, [("first", "<u8"), ("last", "<u8"), ("ids", "<u2", MOST_IDS), ("size", "<u2"), ("n", "<u2")])

    def encode(self, word: str) -> bytes:
        return array("H", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def encoded(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run."""
        words = [r.decode() for r in runs]
        # one run to the tokenizer: letters that its normalizer maps one by one
        plain = [i for i, w in enumerate(words) if w.isalpha() and max(w) < "\u0130"]
        out = [b""] * len(words)
        if plain:
            text = " ".join([words[i] for i in plain]).lower()
            if not text.isascii():
                text = _BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            got = self.bare.encode(text, add_special_tokens=False)
            ids = array("H", got.ids).tobytes()
            ends = (2 * np.cumsum(np.bincount(got.word_ids, minlength=len(plain)))).tolist()
            for i, start, stop in zip(plain, [0, *ends], ends, strict=False):
                out[i] = ids[start:stop]
        for i in {*range(len(words))}.difference(plain):
            out[i] = self.encode(words[i])
        return out

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of every run of text, its number of ids, and the ids in a row."""
        gap = np.frombuffer(b"\1" + text.translate(_GAPS) + b"\1", np.uint8)
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turns[::2], turns[1::2]
        raw, cut = np.frombuffer(text, np.uint8), ends.copy()
        more = np.flatnonzero(_ENDS[raw[ends - 1]]) if len(ends) else ends
        while len(more):
            cut[more] -= 1
            more = more[cut[more] > starts[more]]
            more = more[_ENDS[raw[cut[more] - 1]]]
        cut = cut[(cut > starts) & (cut < ends)]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        text = bytes(8) + text + bytes(8)
        eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).copy()  # the 8 bytes from each place on
        size = ends - starts
        first = eight[starts + 8] & _LOW[np.minimum(size, 8)]
        last = np.where(size > 8, eight[ends], np.uint64(0))
        at = (mix(first + mix(last + size.astype(np.uint64))) & np.uint64(PLACES - 1)).astype(np.int64)
        held = self.table.take(at)
        known = (held["first"] == first) & (held["last"] == last) & (held["size"] == size)
        n = held["n"].astype(np.int64)
        new = np.flatnonzero(~known)
        runs = [text[i:j] for i, j in zip((starts[new] + 8).tolist(), (ends[new] + 8).tolist(), strict=True)]
        once = list(dict.fromkeys(runs))
        found = dict(zip(once, self.encoded(once), strict=True))
        codes = list(map(found.__getitem__, runs))
        n[new] = np.fromiter(map(len, codes), np.int64, len(codes)) >> 1
        flat = np.frombuffer(b"".join(codes), "<u2")
        out = np.empty(int(n.sum()), "<u2")
        old = np.repeat(known, n)
        out[old] = held["ids"][known[:, None] & (np.arange(MOST_IDS) < n[:, None])]
        out[~old] = flat
        stop = np.cumsum(n[new])
        fits = (size[new] <= 16) & (n[new] <= MOST_IDS)
        place, one = np.unique(at[new[fits]], return_index=True)
        new, begin = new[fits][one], (stop - n[new])[fits][one]
        padded = np.append(flat, np.zeros(MOST_IDS, "<u2"))
        for name, values in (("first", first[new]), ("last", last[new]), ("size", size[new]), ("n", n[new]), ("ids", padded[begin[:, None] + np.arange(MOST_IDS)])):
            self.table[name][place] = values
        return starts, n, out


_words: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(held: list[bytes], words: WordIds) -> list[bytes]:
    """The ids of every text, as little-endian uint16."""
    # a text with "<|" isn't lower-cased: a special token might appear that it doesn't have
    special = {i: b"".join(words.encode(w.decode()) for w in t.split()) for i, t in enumerate(held) if b"<|" in t}
    plain = [b"" if i in special else t.lower() for i, t in enumerate(held)]
    starts, n, ids = words.of(b"\n".join(plain))
    begin = np.cumsum([0, *(len(t) + 1 for t in plain)])
    stop = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, begin)]
    return [special[i] if i in special else ids[stop[i] : stop[i + 1]].tobytes() for i in range(len(held))]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("deal", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        if tokenizer not in _words:
            _words.clear()
            _words[tokenizer] = WordIds(tokenizer)
        words = _words[tokenizer]
        end = np.array([end_id], "<u2").tobytes()
        for b in chunks(batches, limit=1 << 20):
            ids = encode_texts(texts(b), words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x + end for x in ids], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, deal long, ids binary")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Of all documents: how many hold each token id, their number, their mean length."""

    def run(batches):
        if _words:  # all is tokenized: later stages get this worker without the tokenizer
            _words.clear()
            trim()
        df, at, n, total = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0, 0
        for b in batches:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x, "<u2")
                place = np.arange(len(x), dtype=np.int32)
                at[x] = place  # of equal ids one place stays, whichever
                df[x[at[x] == place]] += 1
                n, total = n + 1, total + len(x)
        held = np.flatnonzero(df)
        what = np.concatenate([held, [COUNT, LENGTH]])
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(np.concatenate([df[held], [n, total]]))], names=["what", "c"])

    sums = tokens.select("ids").mapInArrow(run, "what long, c long").groupBy("what").agg(F.sum("c").alias("c"))
    got = {r["what"]: r["c"] for r in sums.collect()}  # as many rows as the vocabulary and two
    df = np.zeros(1 << 16, np.int64)
    for i in got.keys() - {COUNT, LENGTH}:
        df[i] = got[i]
    n = got.get(COUNT, 0)
    return df, n, got.get(LENGTH, 0) / max(n, 1)


def neighbour_scores(ids: list[np.ndarray], stats=None, k1: float = 1.2, b: float = 0.75):
    """A function: document -> BM25 score of every document of the shard for its terms.

    stats: ``statistics`` of all documents; without, these are all."""
    n = len(ids)
    lens = np.array([len(x) for x in ids], np.float64)
    key = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in ids]) << 16 | np.concatenate(ids)
    pair, tf = np.unique(key, return_counts=True)
    doc, term = pair >> 16, pair & 0xFFFF
    start = np.searchsorted(doc, np.arange(n + 1))
    by_term = np.argsort(term, kind="stable")
    here = np.bincount(term, minlength=1 << 16)
    first = np.cumsum(here) - here
    df, total, mean = stats or (here, n, lens.mean())
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    w = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / mean)))[by_term]
    doc = doc[by_term]

    def score(seed: int) -> np.ndarray:
        at = term[start[seed] : start[seed + 1]]
        size = here[at]
        take = np.arange(size.sum()) + np.repeat(first[at] - np.cumsum(size) + size, size)
        return np.bincount(doc[take], w[take], n)

    return score


def fill(ids: list[np.ndarray], window: int, stats=None):
    """Sequences of (document, start, length) for one shard. stats: as in neighbour_scores."""
    n = len(ids)
    left, lens = np.ones(n, bool), np.array([len(x) for x in ids])
    score = neighbour_scores(ids, stats)
    out, carry, first = [], None, 0
    while True:
        if carry is None:
            while first < n and not left[first]:
                first += 1
            if first == n:
                return out
            carry = (first, 0)
            left[first] = False
        seq, room, seed = [], window, carry[0]
        order = None
        while room and carry is not None:
            d, at = carry
            size = min(room, int(lens[d]) - at)
            seq.append((d, at, size))
            room -= size
            carry = (d, at + size) if at + size < lens[d] else None
            if room and carry is None:
                if order is None:
                    rest = np.flatnonzero(left)
                    order = iter(rest[np.argsort(-score(seed)[rest], kind="stable")].tolist())
                if (d := next(order, None)) is not None:
                    left[d] = False
                    carry = (d, 0)
        if not room:
            out.append(seq)
        else:
            out += powers(seq, window - room)


def powers(seq: list[tuple[int, int, int]], total: int):
    """The pieces cut into sequences whose lengths are powers of two."""
    out, rest = [], list(seq)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            d, at, size = rest.pop(0)
            take = min(room, size)
            part.append((d, at, take))
            room -= take
            if take < size:
                rest.insert(0, (d, at + take, size - take))
        out.append(part)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, window: int = WINDOW, shard_docs: int = SHARD_DOCS, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack every document (doc_id, text) into sequences of at most ``window`` tokens.

    One row per piece. A null or empty text is its end id alone. Rows that repeat a doc_id
    are packed each; further columns are ignored. An empty table gives no rows. A null
    doc_id stays null. ``window`` must be a power of two; the vocabulary must fit 16 bits.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or default_tokenizer()
    tokens = materialize(tokenized(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("deal"), "text"), path, end_id), "tokens")
    stats = statistics(tokens)
    shards = max(1, -(-stats[1] // shard_docs))
    dealt = tokens.select("doc_id", F.pmod("deal", F.lit(shards)).alias("shard"), "ids")
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        doc_ids = group.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
        shard = group.column("shard")[0].as_py()
        rows = []
        for s, seq in enumerate(fill(ids, window, shared.value)):
            offset = 0
            for d, at, size in seq:
                crc = zlib.crc32(ids[d][at : at + size].astype("<u4").tobytes())
                rows.append((doc_ids[d], at, size, crc, len(ids[d]), shard << 32 | s, offset))
                offset += size
        trim()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return dealt.groupBy("shard").applyInArrow(run, PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
