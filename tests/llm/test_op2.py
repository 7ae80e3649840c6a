import numpy as np

from quern.llm import op2_licences as m


def brute(text):
    weights, bias, heat = m.train()
    n, hits = 0, []
    for i, line in enumerate((text or "").split("\n")):
        n += bool(line.strip(" \t\n\r\x0b\x0c"))
        w = m.words_of(line)
        grams = [g for g in m.ngrams(w) if g in weights]
        if not grams:
            continue
        z = np.array([weights[g] for g in grams]).sum(0) + np.array(bias)
        p = m._softmax(z / heat)
        y = int(z.argmax())
        cover = max((len(set(w) & set(m.words_of(t))) / len(set(m.words_of(t))) for t in m.NOTICES.get(m.FAMILIES[y], ["x"])))
        if y and p[y] >= m.THRESHOLD and cover >= m.CONFIRM:
            hits.append((p[y], -i, m.FAMILIES[y]))
    best = max(hits, default=None)
    return n, len(hits), best and best[2]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = m.op2_licences(spark, sf).collect()
    assert {r.doc_id: (r.n_paragraphs, r.n_licences, r.family) for r in rows} == {d: brute(t) for d, t in docs.items()}
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved."}
    for r in rows:
        have = {f for f, t in lines.items() if t in docs[r.doc_id].split("\n")}
        assert (r.family in have) if have else r.family is None


def test_families_and_unknown(spark, odd, empty):
    texts = [t for n in m.NOTICES.values() for t in n] + m.OTHERS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in m.scan(df).collect()}
    want = [f for f, n in m.NOTICES.items() for _ in n] + [None] * len(m.OTHERS)
    assert [got[i] for i in range(len(want))] == want
    assert m.scan(odd).count() == odd.count() and m.scan(empty).count() == 0
