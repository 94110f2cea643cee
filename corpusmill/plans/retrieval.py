"""Retrieval queries on documents, embeddings, pages and the part-supplier graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..store import materialise
from .indexes import text_index

TERMS = ["the", "thing", "der", "que", "tion", "license"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top(text_index(spark, d).bm25(TERMS).withColumnRenamed("id", "doc_id"), 10, "doc_id")


_TOK = "tok AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS term FROM documents)"
BM25_SQL = f"""
WITH {_TOK}, dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, ln(n - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df WHERE term IN ({_LIST}))
SELECT doc_id, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10
"""


def lexical(spark: SparkSession, d: str) -> DataFrame:
    """From the stored index. The tables have no titles: a document's first 40 characters stand for one."""
    return text_index(spark, d).overlap(TERMS, "head").select(F.col("id").alias("doc_id"), "source", "score")


_LEX = f"""lex AS (SELECT doc_id, source, round(len(hit) / {len(TERMS)}e0 + CASE WHEN len(list_filter(hit, lambda t: contains(lower(substring(text, 1, 40)), t))) > 0 THEN 0.1e0 ELSE 0e0 END, 4) AS score
FROM (SELECT doc_id, source, text, list_intersect([{_LIST}], regexp_extract_all(lower(text), '[0-9a-z_]+')) AS hit FROM documents) WHERE len(hit) > 0)"""


def _query(spark: SparkSession, d: str) -> list[float]:
    return _t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]  # the query vector, one row


def dense(spark: SparkSession, d: str) -> DataFrame:
    return R.dense(_t(spark, d, "embeddings"), _query(spark, d))


_DEN = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), den AS (SELECT vec_id, label, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::DOUBLE * q[i])), 6) AS score FROM embeddings, q)"


def rrf(spark: SparkSession, d: str) -> DataFrame:
    a = R.ranked(lexical(spark, d), 48, "doc_id")
    b = R.ranked(dense(spark, d).withColumnRenamed("vec_id", "doc_id"), 48, "doc_id")
    return R.top(R.fuse([a, b], "doc_id"), 20, "doc_id")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    a = R.top(lexical(spark, d), 40, "doc_id")
    b = R.top(dense(spark, d).withColumnRenamed("vec_id", "doc_id"), 40, "doc_id")
    return R.top(R.hybrid(a, b, "doc_id"), 20, "doc_id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    own = dense(spark, d)
    labels = own.groupBy("label").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "label").limit(2)
    return R.top(own.join(F.broadcast(labels.select("label")), "label", "left_semi"), 12, "vec_id").select("vec_id", "label", "score")


def boosted(spark: SparkSession, d: str) -> DataFrame:
    own = lexical(spark, d).join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    score = (F.col("score") + F.when(F.col("lang") == "en", 0.22).when(F.col("lang") == "de", 0.14).otherwise(0.0)) * F.when(F.col("source") == "src0", 0.45).otherwise(1.0)
    return R.top(own.select("doc_id", F.round(score, 6).alias("score")), 20, "doc_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("target"))


_EDGE = """edge AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)"""


def indegree(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(50)


def expansion(spark: SparkSession, d: str) -> DataFrame:
    score = _t(spark, d, "pages").select("page_id", (F.length("url") / 100.0).alias("base"))
    return edges(spark, d).join(score, "page_id").groupBy("target").agg(F.round(F.sum(F.col("base") * 0.08), 6).alias("bonus"))


def related_statutes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("statute_id")).distinct()


#: The cases asked for are those whose id is divisible by this, against all others.
ASKED = 50


def related_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases that share a statute with one that is asked for; supplier groups of any size are split by adaptive skew joins. As many tasks as the rows and pairs need make them distinct."""
    lines = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    pairs = materialise(R.distinct_in_parts(lines, lines.count(), "l_partkey", "l_suppkey"), "case-statutes")
    asked = F.col("l_partkey") % ASKED == 0
    met = pairs.groupBy("l_suppkey").agg((F.count("*") * F.count_if(asked)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    a = pairs.filter(asked).withColumnRenamed("l_partkey", "case_id")
    shared = a.join(pairs.withColumnRenamed("l_partkey", "related_id"), "l_suppkey").filter("case_id <> related_id").select("case_id", "related_id")
    return R.distinct_in_parts(shared, met, "case_id", "related_id")


def shortlist(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import char_windows

    docs = R.top(lexical(spark, d), 24, "doc_id").select("doc_id", "score")
    return _t(spark, d, "documents").select("doc_id", "text").join(F.broadcast(docs), "doc_id").select("doc_id", "score", F.posexplode(char_windows(F.col("text"))).alias("chunk", "w")).select("doc_id", "score", "chunk", F.length("w").alias("n_chars"))


_CLEAN = r"trim(regexp_replace(replace(text, '+', ' '), '[\s\x{0b}\p{Z}]+', ' ', 'g'))"
_WIN = "CASE WHEN length(text) <= 900 THEN 1 ELSE ceil((length(text) - 900) / 780e0)::INT + 1 END"
QUERIES = {
    "bm25_topk": bm25_topk,
    "lexical_overlap_topk": lambda s, d: R.top(lexical(s, d), 20, "doc_id"),
    "lexical_topk_per_source": lambda s, d: R.top_per_group(lexical(s, d), "source", 3, "doc_id"),
    "dense_topk": lambda s, d: R.top(dense(s, d), 10, "vec_id"),
    "dense_topk_per_label": lambda s, d: R.top_per_group(dense(s, d), "label", 3, "vec_id"),
    "dense_candidates_topk": candidates,
    "rrf_fusion": rrf,
    "hybrid_merge_boost": hybrid,
    "boosted_rank": boosted,
    "doc_shortlist_chunks": shortlist,
    "citation_edges": edges,
    "citation_indegree": indegree,
    "graph_expansion": expansion,
    "related_statutes": related_statutes,
    "related_cases": related_cases,
}
_RANK = "row_number() OVER (ORDER BY score DESC, {0}) AS rank"
SQL = {
    "bm25_topk": BM25_SQL,
    "lexical_overlap_topk": f"WITH {_LEX} SELECT * FROM lex ORDER BY score DESC, doc_id LIMIT 20",
    "lexical_topk_per_source": f"WITH {_LEX} SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT AS rank FROM lex QUALIFY rank <= 3",
    "dense_topk": f"WITH {_DEN} SELECT * FROM den ORDER BY score DESC, vec_id LIMIT 10",
    "dense_topk_per_label": f"WITH {_DEN} SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM den QUALIFY rank <= 3",
    "dense_candidates_topk": f"WITH {_DEN}, l AS (SELECT label FROM den GROUP BY label ORDER BY max(score) DESC, label LIMIT 2) SELECT vec_id, label, score FROM den WHERE label IN (SELECT label FROM l) ORDER BY score DESC, vec_id LIMIT 12",
    "rrf_fusion": f"WITH {_LEX}, {_DEN}, a AS (SELECT doc_id, {_RANK.format('doc_id')} FROM lex QUALIFY rank <= 48), b AS (SELECT vec_id AS doc_id, {_RANK.format('vec_id')} FROM den QUALIFY rank <= 48) SELECT doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20",
    "hybrid_merge_boost": f"WITH {_LEX}, {_DEN}, a AS (SELECT doc_id, score AS x FROM lex ORDER BY score DESC, doc_id LIMIT 40), b AS (SELECT vec_id AS doc_id, score AS y FROM den ORDER BY score DESC, vec_id LIMIT 40) SELECT doc_id, round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) * 1.2e0 ELSE coalesce(x, y) END, 6) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20",
    "boosted_rank": f"WITH {_LEX} SELECT doc_id, round((score + CASE lang WHEN 'en' THEN 0.22e0 WHEN 'de' THEN 0.14e0 ELSE 0e0 END) * CASE WHEN lex.source = 'src0' THEN 0.45e0 ELSE 1e0 END, 6) AS score FROM lex JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20",
    "doc_shortlist_chunks": f"WITH {_LEX}, s AS (SELECT doc_id, score FROM lex ORDER BY score DESC, doc_id LIMIT 24), c AS (SELECT doc_id, score, text, unnest(range(0, {_WIN}))::INT AS chunk FROM (SELECT doc_id, {_CLEAN} AS text FROM documents) JOIN s USING (doc_id) WHERE text <> '') SELECT doc_id, score, chunk, length(trim(substring(text, chunk * 780 + 1, 900)))::INT AS n_chars FROM c",
    "citation_edges": f"WITH {_EDGE} SELECT * FROM edge",
    "citation_indegree": f"WITH {_EDGE} SELECT target, count(*)::BIGINT AS n FROM edge GROUP BY target ORDER BY n DESC, target LIMIT 50",
    "graph_expansion": f"WITH {_EDGE} SELECT target, round(sum(length(url) / 100e0 * 0.08e0), 6) AS bonus FROM edge JOIN pages USING (page_id) GROUP BY target",
    "related_statutes": "SELECT DISTINCT l_partkey AS case_id, l_suppkey AS statute_id FROM lineitem",
    "related_cases": "WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT DISTINCT a.l_partkey AS case_id, b.l_partkey AS related_id FROM p a JOIN p b USING (l_suppkey) WHERE a.l_partkey % 50 = 0 AND a.l_partkey <> b.l_partkey",
}
