"""Search over chunks of documents with all boosts: fused ranks, document shortlist, titles, authority, regions, references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as R


@dataclass(frozen=True)
class Boosts:
    """Weights and list lengths of a search."""

    rrf_k: int = 60
    dense_k: int = 12
    bm25_k: int = 12
    document_k: int = 48
    shortlist_k: int = 96
    most_chunks: int = 8000
    document: float = 0.2
    hierarchy: float = 0.12
    exact: float = 0.22
    ancestor: float = 0.14
    descendant: float = 0.08
    unrelated: float = 0.45
    local: float = 0.58
    graph: float = 0.08
    chunk_title: float = 0.15
    document_title: float = 0.18
    rank: float = 0.03
    other_level: float = 0.5


@dataclass(frozen=True)
class Asked:
    """What a query asks for: its text, titles in it count; authority; whether it names a region; whether it is about local rules."""

    text: str
    authority: bool = False
    region: bool = False
    local: bool = False
    level: str | None = None


def _regional(score: Column, asked: Asked, b: Boosts, ranked: bool) -> Column:
    """``relation``: 0 none, 1 descendant, 2 ancestor, 3 exact; ``local``, ``jurisdiction_rank`` of the row."""
    if not asked.region:
        return F.when(F.col("local"), score * (min(0.82, b.local + 0.18) if asked.local else b.local)).otherwise(score)
    above = score + b.ancestor + (F.col("jurisdiction_rank") * b.rank if ranked and asked.authority else 0.0)
    relation = F.col("relation")
    return F.when(relation == 3, score + b.exact).when(relation == 2, above).when(relation == 1, score + b.descendant).when(F.col("local"), score * b.unrelated).otherwise(score)


def shortlist(dense: DataFrame, bm25: DataFrame, documents: DataFrame, asked: Asked, b: Boosts = Boosts()) -> DataFrame:
    """doc_id, score, place of the best documents. ``dense`` and ``bm25``: doc_id, score; ``documents``: doc_id, title, level, effect_rank, relation, local, jurisdiction_rank.

    The lists have at most ``document_k`` rows each, so the rows joined are bounded and broadcast.
    """
    fused = R.fuse([R.ranked(x, b.document_k, "doc_id") for x in (dense, bm25)], "doc_id")
    own = documents.join(F.broadcast(fused), "doc_id")
    score = F.col("score") + (F.col("effect_rank") * b.hierarchy if asked.authority else 0.0)
    score = _regional(score, asked, b, False) + F.when((F.col("title") != "") & F.contains(F.lit(asked.text), F.col("title")), b.document_title).otherwise(0.0)
    if asked.level is not None:
        score = F.when(F.col("level") == asked.level, score).otherwise(score * b.other_level)
    best = R.top(own.select("doc_id", score.alias("score")), b.shortlist_k, "doc_id")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # after the limit


def candidate_chunks(chunks: DataFrame, documents: DataFrame, b: Boosts = Boosts()) -> DataFrame:
    """Chunks of the shortlisted documents, best documents first, ``most_chunks`` at most: those columns and ``doc_score``."""
    own = chunks.join(F.broadcast(documents.select("doc_id", F.col("score").alias("doc_score"), "place")), "doc_id")  # a shortlist's rows
    return own.orderBy("place", "position", "chunk_id").limit(b.most_chunks).drop("place")


def search(candidates: DataFrame, dense: DataFrame, bm25: DataFrame, first_chunks: DataFrame, asked: Asked, k: int = 6, b: Boosts = Boosts()) -> DataFrame:
    """chunk_id and score of the best chunks.

    ``candidates``: chunk_id, doc_score, title, level, effect_rank, relation, local, jurisdiction_rank, refs (titles, two count);
    ``dense`` and ``bm25``: chunk_id, score of candidates; ``first_chunks``: title, chunk_id. All candidates have a base score of their document,
    so a chunk that is in no list may be found. A reference passes a share of the base score, before boosts, to the first chunk of the
    document it names; a chunk of another level than the one asked for gets half its score, and neither boosts nor passes on. Of the order in which
    boosts meet nothing hangs: what references give is added last, and is not multiplied.
    """
    fused = R.fuse([R.ranked(dense, b.dense_k, "chunk_id"), R.ranked(bm25, b.bm25_k, "chunk_id")], "chunk_id").withColumnRenamed("score", "fused")
    own = candidates.join(F.broadcast(fused), "chunk_id", "left").withColumn("base", F.coalesce("fused", F.lit(0.0)) + F.col("doc_score") * b.document)
    other = F.lit(False) if asked.level is None else ~F.coalesce(F.col("level") == asked.level, F.lit(False))
    score = F.col("base") + F.when((F.col("title") != "") & F.contains(F.lit(asked.text), F.col("title")), b.chunk_title).otherwise(0.0)
    score = _regional(score + (F.col("effect_rank") * b.hierarchy if asked.authority else 0.0), asked, b, True)
    own = own.withColumn("score", F.when(other, F.col("base") * b.other_level).otherwise(score))
    named = own.filter(~other).select("base", F.explode(F.slice("refs", 1, 2)).alias("title")).groupBy("title").agg(F.sum("base").alias("given"))
    passed = first_chunks.join(F.broadcast(named), "title").groupBy("chunk_id").agg((F.sum("given") * b.graph).alias("given"))  # two titles a candidate at most
    both = own.select("chunk_id", "score").unionByName(passed.withColumnRenamed("given", "score"))
    return R.top(both.groupBy("chunk_id").agg(F.round(F.sum("score"), 6).alias("score")), k, "chunk_id")
