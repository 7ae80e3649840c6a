import hashlib
import random
import re

import numpy as np

from quern.llm.common import word_hashes
from quern.llm.op4_lines import Sums, dedup, drop_repeats, op4_lines, within_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, least=8):
    """Kept text of each (doc_id, text), documents in order."""
    seen, by_len, out = {}, {}, []
    for _, t in docs:
        keep = []
        for line in (t or "").split("\n"):
            w = tuple(WORD.findall(line.translate(UP)))
            if not w:
                keep.append(line)
                continue
            gone = w in seen
            if not gone and len(w) >= least:
                gone = any(within_one(w, x) for n in (len(w) - 1, len(w), len(w) + 1) for x in by_len.get(n, ()) if len(x) >= least)
            if w not in seen:
                seen[w] = True
                by_len.setdefault(len(w), []).append(w)
            if not gone:
                keep.append(line)
        out.append("\n".join(keep))
    return out


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {d: md5(t) for (d, _), t in zip(docs, brute(docs), strict=True)}
    assert want == {r.doc_id: r.text_md5 for r in op4_lines(spark, sf).collect()}


def test_edits(spark):
    rng = random.Random(3)
    lines = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(6, 14))] for _ in range(12)]
    docs = []
    for i in range(120):
        w = list(rng.choice(lines))
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.34:
                w[at] = "zz"
            elif kind < 0.67:
                w.insert(at, rng.choice("abc"))
            else:
                del w[at]
        docs.append((i, " ".join(w) + ("\n\nx" if i % 5 == 0 else "")))
    got = {r.doc_id: r.line_text for r in dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: t for (d, _), t in zip(docs, brute(docs), strict=True)}


def test_odd_rows(spark, odd, empty):
    got = dedup(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.line_text for r in got}[1] is None
    assert dedup(empty).count() == 0 and drop_repeats(empty).count() == 0
    kept = {r.doc_id: r.text for r in drop_repeats(odd).collect()}
    assert 4 in kept and kept[4].split("\n")[0] == "one two three four five six" and drop_repeats(odd).columns == odd.columns


def test_sums():
    w = word_hashes([b"a", b"b", b"c", b"d", b"e"])
    d = Sums(w).deletions()
    for i in range(5):
        assert Sums(np.delete(w, i)).whole() == d[i]
    whole, less = (Sums(x).halves()[0].tolist() for x in (w, np.delete(w, 4)))
    assert whole[2:] != whole[:2]
    assert set(whole) & set(less)


def test_words_of_lines_are_hashed_at_once():
    """As the same lines word by word, for under half of what that costs."""
    import time

    import pyarrow as pa

    from quern.llm.common import word_hashes
    from quern.llm.op4_lines import Sums, _hashed, _lines

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run([self.batch]))

    rng = np.random.default_rng(0)
    held = [" ".join(f"w{x}" + "\n" * (x % 9 == 0) for x in rng.integers(0, 60000, 400).tolist()) for _ in range(1500)] + [None, "", "\n\n \n", "\nA b\n a\tB\n"]
    docs = Docs()
    docs.batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(held))), "th": [0] * len(held), "text": held})
    took = time.process_time()
    got = pa.Table.from_batches(_lines(docs, 8)).to_pylist()
    took = time.process_time() - took
    plain = time.process_time()
    want = [(k, i, found) for k, t in enumerate(held) for i, line in enumerate((t or "").encode().lower().split(b"\n")) if (found := line.split())]
    Sums(word_hashes([w for _, _, words in want for w in words]), [len(words) for _, _, words in want]).whole()
    plain = time.process_time() - plain
    assert [(r["doc_id"], r["line"], r["n"]) for r in got] == [(k, i, len(words)) for k, i, words in want]
    same = {}
    for r, (_, _, words) in zip(got, want, strict=True):
        assert same.setdefault(tuple(words), (r["h"], r["h2"])) == (r["h"], r["h2"])
    assert len(set(same.values())) == len(same)
    assert took < plain / 2 + 0.2
    # two long words whose sums of powers agree modulo 2**64
    a = bytes(97 + bin(i).count("1") % 2 for i in range(4096))
    h, starts = _hashed(a + b" " + a.translate(bytes.maketrans(b"ab", b"ba")) + b" " + a.upper())
    assert h[0] != h[1] and h[0] == h[2] and starts.tolist() == [0, 4097, 8194]
