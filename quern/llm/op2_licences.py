"""License scans: a trained paragraph classifier.

A multinomial logistic regression over word n-grams tells licence families from each other
and from unknown text. It is trained on the notices below (whole, clipped and with words
around or missing) against ordinary sentences that share their words; its temperature is
fitted on variants kept from training, so that the unknown class is calibrated. Features are
the 1- to 3-grams that hold one of the notices' telling words, so a paragraph without such a
word is unknown by the model itself and is never cut into n-grams. A prediction counts when
the family's template confirms it: enough of the template's words stand in the paragraph.

Training needs only the constants below; scanning is DataFrame functions alone.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, table

#: Short notices of licence families.
NOTICES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
}
#: Words that tell notices from other text.
TELLING = "license licensed apache mit gnu gpl bsd mozilla creative commons cc rights reserved redistribution redistribute permission copyright nc noncommercial attribution public proprietary clause reproduced".split()
#: Ordinary sentences with the same words.
OTHERS = [
    "He lost his driving license last year.", "The public school gave permission for the trip.", "She studied physics at MIT before moving.", "The Apache people live in the southwest.", "We reserved a table for eight.",
    "Human rights are on the agenda.", "The creative team met in the commons.", "A general election in public life.", "Copyright law is complicated.", "The clause was struck from the contract.", "The public library is free of charge.",
    "Redistribution of wealth is debated.", "Attribution of the painting is unclear.", "No license is needed to fish here.", "A doctor must be licensed in the state.", "The gnu is a large antelope.", "All rights of the public were discussed.", "Version 3 of the report is under review.",
]
CONFIRM = 0.7
THRESHOLD = 0.5
FAMILIES = ("unknown", *NOTICES)


def words_of(text: str) -> list[str]:
    parts = (w.strip(".") for w in re.split(r"[^a-z0-9.]+", text.lower()))
    return [w for w in parts if w]


def ngrams(words: list[str]) -> set[str]:
    telling = set(TELLING)
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if telling & set(words[i : i + n])}


@cache
def train() -> tuple[dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Weights of each n-gram by family, biases, temperature."""
    rng = random.Random(0)
    filler = "the of and report house year people said new day work world more time about".split()
    data = []
    for y, family in enumerate(FAMILIES):
        for text in NOTICES.get(family, OTHERS):
            w = words_of(text)
            data.append((y, w))
            for _ in range(24 if y else 12):
                v = [x for x in w if rng.random() > 0.06] or w
                around = [rng.choice(filler) for _ in range(rng.randint(0, 8))]
                cut = rng.randint(0, len(around))
                data.append((y, around[:cut] + v + around[cut:]))
    data += [(0, [rng.choice(filler) for _ in range(12)]) for _ in range(40)]
    data += [(0, [rng.choice(filler), t, rng.choice(filler)]) for t in TELLING for _ in range(3)]
    names = sorted(set().union(*(ngrams(w) for _, w in data)))
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(data), len(names) + 1))
    x[:, -1] = 1
    for i, (_, w) in enumerate(data):
        x[i, [place[g] for g in ngrams(w)]] = 1
    y = np.array([d[0] for d in data])
    kept = np.arange(len(data)) % 5 == 4
    theta = np.zeros((x.shape[1], len(FAMILIES)))
    xt, want = x[~kept], np.eye(len(FAMILIES))[y[~kept]]
    for _ in range(300):
        p = _softmax(xt @ theta)
        theta -= 2.0 * (xt.T @ (p - want) / len(xt) + 2e-4 * theta)
    scores = x[kept] @ theta
    loss = {t: -np.log(_softmax(scores / t)[np.arange(kept.sum()), y[kept]] + 1e-12).mean() for t in np.linspace(0.3, 3, 28)}
    heat = float(min(loss, key=loss.get))
    return {g: tuple(map(float, theta[i])) for g, i in place.items()}, tuple(map(float, theta[-1])), heat


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _grams(n: int):
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, family, probability of every row of docs (doc_id, text).

    Paragraphs are lines with words. family: that of the likeliest confirmed paragraph (the
    first of equals), null if there is none. A null text has no paragraphs. Rows repeated
    whole have the same result each; further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    weights, bias, heat = train()
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    telling = r"(?i)(?<![a-z0-9])(?:" + "|".join(TELLING) + r")(?![a-z0-9])"
    lines = named.filter(F.col("text").rlike(telling)).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).filter(F.col("line").rlike(telling))
    words = F.filter(F.transform(F.split(F.lower("line"), r"[^a-z0-9.]+"), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")
    lines = lines.select("doc_id", "th", "place", words.alias("words"))
    grams = [_grams(n) for n in (1, 2, 3)]
    one = lines.select("doc_id", "th", "place", "words", F.explode(F.array_distinct(F.concat(*grams))).alias("gram"))
    columns = [f"s{i}" for i in range(len(FAMILIES))]
    table_ = spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"{c} double" for c in columns))
    hits = one.join(F.broadcast(table_), "gram")  # as many rows as the fixed notices have n-grams
    sums = hits.groupBy("doc_id", "th", "place").agg(*[(F.sum(c) + F.lit(b)).alias(c) for c, b in zip(columns, bias, strict=True)], F.first("words").alias("words"))
    top = F.greatest(*columns)
    total = sum((F.exp((F.col(c) - F.col("top")) / F.lit(heat)) for c in columns), F.lit(0.0))
    best = sums.withColumn("top", top).withColumn("probability", 1 / total)
    family, share = F.lit(None).cast("string"), F.lit(0.0)
    for c, name in list(zip(columns, FAMILIES, strict=True))[1:]:
        here = F.col(c) == F.col("top")
        family = F.when(here, F.lit(name)).otherwise(family)
        parts = [sorted(set(words_of(t))) for t in NOTICES[name]]
        cover = F.greatest(F.lit(0.0), *[F.size(F.array_intersect(F.array_distinct("words"), F.array(*map(F.lit, p)))) / F.lit(float(len(p))) for p in parts])
        share = F.when(here, cover).otherwise(share)
    best = best.withColumn("family", F.when(F.col("s0") < F.col("top"), family)).withColumn("cover", share)
    good = best.filter(F.col("family").isNotNull() & (F.col("probability") >= THRESHOLD) & (F.col("cover") >= CONFIRM))
    found = good.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.countDistinct("place").alias("n_licences"), F.max_by(F.struct("family", "probability"), F.struct("probability", -F.col("place"))).alias("m"))
    found = materialize(found, "licences")
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = named.select("doc_id", "th", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_paragraphs"))
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.col("m.family").alias("family"), F.round("m.probability", 6).alias("probability"))


def op2_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
