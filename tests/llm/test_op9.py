import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import quern.llm.op9_packing as op9_module
from quern.llm.op9_packing import WordIds, default_tokenizer, encode_texts, fill, op9_packing, pack, statistics


def check(rows, docs):
    tok = Tokenizer.from_file(default_tokenizer())
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    seqs, got = defaultdict(list), defaultdict(int)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in want[r.doc_id])
    assert got == {d: sum(map(len, x)) for d, x in want.items()}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op9_packing(spark, sf).collect(), docs)


def test_scores_use_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_file(default_tokenizer())
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()}
    df = np.zeros(1 << 16, np.int64)
    for x in ids.values():
        df[np.unique(x)] += 1
    stats = df, len(ids), sum(map(len, ids.values())) / len(ids)
    shards = defaultdict(lambda: defaultdict(list))
    for r in pack(docs, shard_docs=25).collect():
        shards[r.sequence_id >> 32][r.sequence_id].append((r.offset, r.doc_id, r.start, r.length))
    other = 0
    for seqs in shards.values():
        held = sorted({p[1] for s in seqs.values() for p in s})
        got = [[(held.index(d), at, size) for _, d, at, size in sorted(seqs[s])] for s in sorted(seqs)]
        assert got == fill([ids[d] for d in held], 2048, stats)
        other += got != fill([ids[d] for d in held], 2048)
    assert len(shards) > 1 and other


def test_odd_rows(spark, odd, empty):
    check(pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert pack(empty).count() == 0


def test_neighbours_come_first():
    rng = np.random.default_rng(0)
    a, b = np.arange(100, 160), np.arange(300, 360)
    ids = [rng.permutation(a if i % 2 == 0 else b) for i in range(32)]
    whole = [seq for seq in fill(ids, 256) if sum(x[2] for x in seq) == 256]
    pure = sum(len({d % 2 for d, _, _ in seq}) == 1 for seq in whole)
    assert pure >= len(whole) - 2


def test_many_texts_at_once():
    """Ids as the tokenizer gives them, for words in and out of a table of fixed size."""
    tok = Tokenizer.from_file(default_tokenizer())
    rng = np.random.default_rng(0)
    held = ["", " ", "a", "a\0", "a\0\0", "A<|endoftext|> x", "x" * 5000, "İstanbul K ǅ µ ª É", "abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq", "a.b.c!!! ... don't", "1234567890123456", "日本語 。"]
    held += ["".join(rng.choice(list("ab\0 .!éÉ\nZ1"), rng.integers(1, 60))) for _ in range(500)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in held]
    words = WordIds(default_tokenizer())
    for cut in (len(held), 5, 1):
        assert [x for i in range(0, len(held), cut) for x in encode_texts([t.encode() for t in held[i : i + cut]], words)] == want


def test_statistics_let_the_tokenizer_go(spark):
    """Counts as by brute force; a worker that counts has tokenized and serves later stages."""
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50, rng.integers(1, 90)).astype("<u2") for _ in range(40)]

    class Tokens:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return spark.createDataFrame(pa.Table.from_batches(run([pa.RecordBatch.from_pydict({"ids": [x.tobytes() for x in ids]})])))

    op9_module._words["path"] = None
    df, n, mean = statistics(Tokens())
    assert not op9_module._words
    assert n == 40 and mean == sum(map(len, ids)) / 40
    assert df[:50].tolist() == [sum(i in x for x in ids) for i in range(50)] and not df[50:].any()
