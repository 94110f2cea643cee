"""Stored tables: stale, fresh and missing ones, and the inverted index against a scan."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import inverted, ranking
from corpusmill.operators.inverted import open_index
from corpusmill.sources import published

TEXTS = ["the law of the land", "A law", "", None, "land land LAND law", "nothing here", "the " * 300 + "law", "x_1 law"]


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS * 20)] + [(None, "law", "s")], "id bigint, text string, source string").write.parquet(path)
    return path


def _open(spark, docs, tmp_path):
    df = spark.read.parquet(docs).withColumn("head", F.substring("text", 1, 6))
    return open_index(spark, str(tmp_path / "index"), [docs], df, "id", "text", ["source", "head"])


def test_bm25(spark, docs, tmp_path):
    index = _open(spark, docs, tmp_path)
    own = spark.read.parquet(docs).filter("id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    for terms in (["law", "the", "missing"], ["land"], ["missing"], ["law", "law"]):
        want = {tuple(r) for r in ranking.bm25(own, terms, "id").collect()}
        assert {tuple(r) for r in index.bm25(terms).collect()} == want
        for least in (-1.0, 0.1, 0.5, 2.0):
            assert {tuple(r) for r in index.bm25(terms, least).collect()} == {x for x in want if x[1] >= least}


def test_overlap(spark, docs, tmp_path):
    index = _open(spark, docs, tmp_path)
    own = spark.read.parquet(docs).filter("id is not null")
    want = {tuple(r) for r in ranking.lexical_overlap(own, ["law", "the", "land"], F.substring("text", 1, 6), "id").select("id", "score").collect()}
    assert {tuple(r) for r in index.overlap(["law", "the", "land"], "head").select("id", "score").collect()} == want and len(want) == 100


def test_blocks(spark, docs, tmp_path, monkeypatch):
    """Small blocks, shards and folders; only folders of asked terms are read."""
    monkeypatch.setattr(inverted, "BLOCK", 7)
    monkeypatch.setattr(inverted, "SHARD_DOCS", 40)
    monkeypatch.setattr(inverted, "BUCKET_DOCS", 20)
    index = _open(spark, docs, tmp_path)
    assert index.facts["buckets"] == 8
    rows = index.blocks(["law"])
    assert rows.select(F.max(F.size("posts"))).first()[0] == 7 and rows.select(F.sum(F.size("posts"))).first()[0] == 100
    assert rows.select("bucket").distinct().count() == 1
    assert "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().toString() or "PartitionFilters: [(bucket" in rows._jdf.queryExecution().toString()
    own = spark.read.parquet(docs).filter("id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    assert {tuple(r) for r in index.bm25(["law", "the"], 0.3).collect()} == {tuple(r) for r in ranking.bm25(own, ["law", "the"], "id").filter("score >= 0.3").collect()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "id bigint, text string, source string").write.parquet(str(tmp_path / "none"))
    index = _open(spark, str(tmp_path / "none"), tmp_path)
    assert index.bm25(["law"]).collect() == [] and index.terms().collect() == []


def test_load_or_build(spark, docs, tmp_path):
    root, built = str(tmp_path / "root"), []

    def build(writer):
        built.append(writer.version)
        writer.write("t", spark.read.parquet(docs).select("id"))
        writer.facts["n"] = 1.5

    one = published.load_or_build(spark, root, [docs], build)  # missing
    assert published.load_or_build(spark, root, [docs], build) == one and len(built) == 1  # fresh
    reader = one.read(spark, "t")
    assert reader.count() == 161 and one.facts == {"n": 1.5}
    spark.createDataFrame([(1000, "new", "s")], "id bigint, text string, source string").write.mode("append").parquet(docs)
    two = published.load_or_build(spark, root, [docs], build)  # stale
    assert two.seq == 1 and two.read(spark, "t").count() == 162 and reader.count() == 161  # who reads the old one goes on
    assert published.load_or_build(spark, root, [docs], build, schema_version=2).seq == 2  # another schema

    def breaks(writer):
        writer.write("t", spark.range(1))
        raise RuntimeError

    with pytest.raises(RuntimeError):
        published.load_or_build(spark, root, [docs], breaks, schema_version=3)
    assert published.current(spark, root).seq == 2 and len(os.listdir(f"{root}/commits")) == 3
    # two builders of one number: both versions are whole, one holds for all readers
    a, b = published.Writer(spark, root), published.Writer(spark, root)
    a.write("t", spark.range(3))
    b.write("t", spark.range(4))
    first, last = published.current(spark, root), None
    for w in (a, b):
        last = w.publish("s")
    assert first.seq == 2 and published.current(spark, root).version == last.version


def test_index_is_dealt(spark, tmp_path):
    """A few documents of one file are cut and sorted by several tasks."""
    from corpusmill.operators import inverted

    docs = spark.range(500).coalesce(1).selectExpr("id AS doc_id", "concat('w', id % 97, ' all x', id) AS text")
    docs.write.parquet(str(tmp_path / "docs"))
    index = inverted.open_index(spark, str(tmp_path / "root"), [str(tmp_path / "docs")], spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text", [])
    assert len(index.version.read(spark, "blocks").inputFiles()) > 2
    assert sorted((r["term"], r["n"]) for r in index.postings(["all", "w3", "x9"]).groupBy("term").count().withColumnRenamed("count", "n").collect()) == [("all", 500), ("w3", 6), ("x9", 1)]
