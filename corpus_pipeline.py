"""A corpus from quality filter to packed sequences, each stage a written table.

The quality filter (6) rejects documents; line dedup (4) cuts repeated lines out of the
rest; the n-gram Jaccard join (3) keeps one document of each group of near copies (word
5-grams, similarity 0.8); mixing (7) repeats and drops documents to meet source targets;
packing (9) returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import op3_jaccard, op4_lines, op6_quality, op7_mixing, op9_packing
from quern.llm.common import materialize, release, table


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_lines.drop_repeats(docs)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component: the smallest doc_id (null last), then the least text
    hash. Rows that repeat a doc_id with an unlike text stay; of rows repeated whole one stays."""
    first = materialize(op3_jaccard.firsts(docs), "first-of-group").select(F.col("doc_id").alias("near_d"), F.col("th").alias("near_t"))
    here = docs.withColumn("near_th", F.xxhash64("text"))
    kept = here.join(first, F.col("doc_id").eqNullSafe(F.col("near_d")) & (F.col("near_th") == F.col("near_t")), "left_semi")
    again = kept.groupBy("doc_id", "near_th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "near_th"])
    return kept.select(*docs.columns)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_mixing.mix(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mixing", mix), ("packing", pack)]

#: Latent axes, index joins and draws are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        now = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = now
    return docs
