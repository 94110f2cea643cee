"""Stages of the corpus pipeline, from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's docs. All but the last return the
columns of documents. Decisions take effect:

1. language: texts without a letter, or nearer to no language than LEAST for their length, go.
2. near_copies: of each group of near-copies (five words, 80 in 100) the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: secrets are masked in the text; n_chars follows.
5. tokens: the kept texts encoded and decoded, as digests by document.

Rows with null doc_id pass stages 2 and 3: nothing can be said of them by id. Of
several rows that share a kept doc_id, equal texts leave one row (the first by all
its columns as JSON), different texts all stay. Other columns, whatever their names,
are carried to the last stage. Empty tables pass through. Where no document names
its language, stage 1 keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, language_id, ngram_join, secret_scan
from ._store import materialise, table

#: The least cosine with the best language, as two rising lines over the number of different trigrams, met at the middle
#: point, and flat beyond the last. Noise is 1 / sqrt(DIMENSIONS); up to the first number a text says too little to go.
LEAST = ((12, 0.0), (64, 0.16), (300, 0.3))
#: Near-copies share 80 in 100 of their shingles of five words; op5's own query has its own figures.
SHINGLE, PERCENT = 5, 80


def least(trigrams: Column) -> Column:
    lines = [low + (trigrams - a) * ((high - low) / (b - a)) for (a, low), (b, high) in zip(LEAST, LEAST[1:])]
    return F.greatest(F.lit(0.0), F.least(*lines, F.lit(LEAST[-1][1])))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.prototypes(docs.filter(~language_id.held_out(F.col("doc_id"))))
    if not model[0]:
        return docs
    free = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column's name
    found = language_id.classify(docs, model, docs.columns, free)
    return found.filter((F.col(free + "lang_pred") != language_id.UNKNOWN) & (F.col(free + "score") >= least(F.col(free + "trigrams")))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialise(ngram_join.near_copies(docs, shingle=SHINGLE, percent=PERCENT), "kept")
    drop = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(ngram_join.small(drop, drop.count()), "doc_id", "left_anti").select(docs.columns)
    twice = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if (n := twice.count()) == 0:
        return left
    ids = ngram_join.small(twice, n)
    several = left.join(ids, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    one = several.groupBy("row.doc_id", "row.text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return left.join(ids, "doc_id", "left_anti").select(docs.columns).union(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialise(decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(ngram_join.small(found, found.count()), "doc_id", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [("language_id", language), ("near_copies", near_copies), ("decontamination", decontaminate), ("secret_scan", secrets), ("byte_bpe", tokens)]

#: SQL expresses none of the learned, signature and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
