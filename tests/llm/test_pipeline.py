import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quern.llm.op9_packing import default_tokenizer
from test_op3 import brute as groups
from test_op4 import brute as kept_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(P.materialize(stage(spark, frames[-1], sf), "stage"))
    assert all(f.columns == COLUMNS for f in frames[:-1])
    rows = [sorted(f.collect(), key=lambda r: r.doc_id) for f in frames[:-1]]
    start, good, cut, single, mixed = rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lost = {r.doc_id for r in start} - {r.doc_id for r in good}
    assert lost and sum(labels.get(d) == 0 for d in lost) > 2 * sum(labels.get(d) == 1 for d in lost)
    want = {r.doc_id: t for r, t in zip(good, kept_lines([(r.doc_id, r.text) for r in good]), strict=True)}
    assert {r.doc_id: r.text for r in cut} == {r.doc_id: want[r.doc_id] for r in good if want[r.doc_id] == r.text or re.search(r"[^\x20\x09-\x0D]", want[r.doc_id])}
    assert all(r.n_chars == len(r.text) for r in cut if r.text != next(g.text for g in good if g.doc_id == r.doc_id))
    assert [r.doc_id for r in single] == sorted({c for _, _, c in groups([(r.doc_id, r.text) for r in cut], 5, 80, 100)})
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id] += 1
    assert set(copies) <= {r.doc_id for r in single} and max(copies.values()) == 2
    tok = Tokenizer.from_file(default_tokenizer())
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r.length for r in frames[-1].collect()) == total


def test_odd_rows(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "The house of the people and the report.", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.columns[0] == "doc_id" and docs.count() <= 4


def test_each_stage_on_odd_rows(spark, sf, odd, empty):
    """Nulls, a very long text, repeated rows, unlike texts of one id, and clashing columns."""
    more = odd.filter("doc_id = 8").withColumn("text", F.lit("another text of the same id"))
    docs = odd.unionByName(more).unionByName(odd.filter("doc_id is null"))
    rows = docs.collect()
    of = {name: P.materialize(stage(spark, docs, sf), "odd") for name, stage in P.STAGES}
    assert all(of[n].columns == docs.columns for n in list(of)[:-1])
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert {tuple(r) for r in of["quality"].collect()} <= {tuple(r) for r in rows}
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))
    assert of["line_dedup"].count() <= len(order) and {r.doc_id for r in of["line_dedup"].collect()} >= {1, 2, 3, 4, 7, 8}
    near = sorted(map(key, of["near_copies"].collect()))
    assert near == sorted({key(r) for r in rows})  # no two unlike texts are near, and one of equal rows stays
    copies = Counter(map(key, of["mixing"].collect()))
    assert set(copies) <= set(map(key, rows)) and of["mixing"].select("copies", "drop").distinct().count() == 1
    tok = Tokenizer.from_file(default_tokenizer())
    assert sum(r.length for r in of["packing"].collect()) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in P.STAGES)


def test_tasks_give_memory_back(monkeypatch):
    """Workers serve all stages, so a task that has read its last slice frees what it can."""
    import pyarrow as pa

    from quern.llm import common

    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    assert [c.num_rows for c in common.chunks([pa.RecordBatch.from_pydict({"text": ["ab", None, "c"]})], limit=2)] == [2, 1]
    assert calls == [1]
