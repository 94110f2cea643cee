"""Stored indexes of the tables: built by the first query that needs one, read by the others, and queries over them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..operators.inverted import Inverted, open_index
from ..sources.published import current, state_of
from ..store import shared_dir


def root(spark: SparkSession, d: str, name: str) -> str:
    """The folder of a stored table over the tables in ``d``."""
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def text_index(spark: SparkSession, d: str) -> Inverted:
    path = f"{d}/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", "source", "lang", F.substring("text", 1, 40).alias("head"))
    return open_index(spark, root(spark, d, "text-index"), [path], docs, "doc_id", "text", ["source", "lang", "head"])


#: Terms and the least score of the queries below.
ASKED, AT_LEAST = ["license", "permission", "software", "zzz"], 2.0


def postings(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).postings(ASKED).select(F.col("id").alias("doc_id"), "term", "tf", "dl")


def bm25_at_least(spark: SparkSession, d: str) -> DataFrame:
    """All documents that score AT_LEAST; blocks that cannot are not opened."""
    return text_index(spark, d).bm25(ASKED, AT_LEAST).withColumnRenamed("id", "doc_id")


def vector_index(spark: SparkSession, d: str) -> vectors.VectorIndex:
    path, at = f"{d}/embeddings.parquet", root(spark, d, "vector-index")
    state = state_of(spark, [path])
    last = current(spark, at)
    if last and last.state == state:
        return vectors.VectorIndex(spark, at, last)
    return vectors.build(spark, at, spark.read.parquet(path), "vec_id", "embedding", state)


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows nearest to vector 0, from the cells that can hold one."""
    query = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id = 0").select("embedding").first()[0]
    return vector_index(spark, d).search(query, 10).select(F.col("id").alias("vec_id"), "label", "score")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The indexed rows after vectors whose id is divisible by 50 have been turned round, and come again under new ids."""
    path, at = f"{d}/embeddings.parquet", root(spark, d, "vector-upserts")
    state = state_of(spark, [path]) + ":turned"
    last = current(spark, at)
    if not last or last.state != state:
        rows = spark.read.parquet(path)
        turned = rows.filter("vec_id % 50 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
        vectors.build(spark, at, rows, "vec_id", "embedding").upsert(turned.unionByName(turned.withColumn("vec_id", -F.col("vec_id") - 1)), "vec_id", "embedding", state)
    return vectors.VectorIndex(spark, at).rows().select(F.col("id").alias("vec_id"), "label", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_LIST = ", ".join(f"'{t}'" for t in ASKED)
_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_]+')) AS term FROM documents), dl AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_]+')) AS dl FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
QUERIES = {"index_postings": postings, "index_bm25_at_least": bm25_at_least, "vector_index_topk": nearest, "vector_index_upsert": upserted}
SQL = {
    "index_postings": f"WITH {_TOK} SELECT doc_id, term, tf::INT AS tf, dl::INT AS dl FROM tf JOIN dl USING (doc_id) WHERE term IN ({_LIST})",
    "index_bm25_at_least": f"""WITH {_TOK}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, ln(n - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df WHERE term IN ({_LIST}))
SELECT doc_id, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id HAVING score >= {AT_LEAST}""",
    "vector_index_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::DOUBLE * q[i])), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10",
    "vector_index_upsert": "WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 50 = 0 AS t FROM embeddings), b AS (SELECT vec_id, label, CASE WHEN t THEN list_transform(e, lambda x: -x) ELSE e END AS e FROM a UNION ALL SELECT -vec_id - 1, label, list_transform(e, lambda x: -x) FROM a WHERE t) SELECT vec_id, label, round(list_sum(e), 6) AS total FROM b",
}
