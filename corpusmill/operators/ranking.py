"""Ranked retrieval: BM25, lexical overlap, dense vectors, rank fusion, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def bm25(docs: DataFrame, terms: list[str], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of documents that hold a query term, without an index: for a text searched once. Only the vocabulary's counts and a row for each document found are shuffled; ids are to be unique."""
    own = docs.select(id_, word_tokens(F.col(text)).alias("t"))
    stats = own.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = own.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.filter(F.col("term").isin(terms)).crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = own.select(id_, F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("t"))
    counted = F.transform(F.array_distinct("t"), lambda q: F.struct(q.alias("term"), F.size(F.filter("t", lambda x: x == q)).alias("tf")))
    hits = asked.select(id_, "dl", F.inline(counted)).join(F.broadcast(idf), "term")  # a row for each query term at most
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(id_).agg(F.round(F.sum(part), 6).alias("score"))


def top(df: DataFrame, k: int, id_: str, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(id_)).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, id_: str, score: str = "score") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(id_)))).filter(F.col("rank") <= k)


#: Rows that one task makes distinct, about.
DISTINCT_ROWS = 2_000_000


def distinct_in_parts(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The distinct rows of ``df``, of which there are ``n``: dealt first, so that no task holds more than about DISTINCT_ROWS in memory, however many rows there are."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // DISTINCT_ROWS))
    return df.repartition(parts, *keys).distinct()


def lexical_overlap(docs: DataFrame, terms: list[str], title: Column, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of distinct query terms in a record, +0.1 where one of them is in its title; without an index. A text is cut into tokens once."""
    query = F.array(*map(F.lit, sorted(set(terms))))
    bonus = lambda hit: F.when(F.exists(hit, lambda t: F.contains(F.lower(title), t)), 0.1).otherwise(0.0)
    scored = F.transform(F.array(F.array_intersect(query, word_tokens(F.col(text)))), lambda hit: F.when(F.size(hit) > 0, F.round(F.size(hit) / len(set(terms)) + bonus(hit), 4)))
    return docs.select("*", F.explode(F.array_compact(scored)).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("score", F.round(dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6)).drop(vector)


def fuse(ranked: list[DataFrame], id_: str) -> DataFrame:
    """Reciprocal rank fusion of lists with columns id and rank (from 1)."""
    parts = [r.select(id_, (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(id_).agg(F.round(F.sum("part"), 9).alias("score"))


def ranked(df: DataFrame, k: int, id_: str) -> DataFrame:
    """The top k with their rank: a bounded list, ranked after the limit."""
    return top(df, k, id_).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_))))


def hybrid(lexical: DataFrame, embedded: DataFrame, id_: str) -> DataFrame:
    """Full outer merge: the larger score, times 1.2 where both lists have the record."""
    a, b = lexical.select(id_, F.col("score").alias("a")), embedded.select(id_, F.col("score").alias("b"))
    return a.join(b, id_, "full_outer").select(id_, F.round(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b") * 1.2).otherwise(F.coalesce("a", "b")), 6).alias("score"))


def search_sources(lexical: DataFrame, embedded: DataFrame, lexical_sources: list[str], embedded_sources: list[str], k: int, recall: int, rerank: Column | None = None, id_: str = "doc_id") -> DataFrame:
    """(id, origin, score): the k best over several sources. Both lists have id, origin and score.

    Of each source and list the ``recall`` best are taken; a record in both has its larger score times 1.2. With ``rerank``, a score
    of the merged rows, the ``recall`` best of all are put in its order first.
    """
    a = top_per_group(lexical.filter(F.col("origin").isin(lexical_sources)), "origin", recall, id_).select(id_, "origin", "score")
    b = top_per_group(embedded.filter(F.col("origin").isin(embedded_sources)), "origin", recall, id_).select(id_, F.col("origin").alias("other"), F.col("score").alias("b"))
    both = F.col("score").isNotNull() & F.col("b").isNotNull()
    merged = a.join(b, id_, "full_outer").select(id_, F.coalesce("origin", "other").alias("origin"), F.round(F.when(both, F.greatest("score", "b") * 1.2).otherwise(F.coalesce("score", "b")), 6).alias("score"))
    if rerank is None:
        return top(merged, k, id_)
    return top(top(merged, recall, id_).withColumn("score", rerank), k, id_)
