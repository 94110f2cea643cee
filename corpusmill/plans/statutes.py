"""Search over chunks with all boosts. Ten documents of the table are the chunks of one; what a table of rules has beside its text is worked out of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statutes as S

ASKED = S.Asked("Is T3 or T5 in force", authority=True, region=True, level="a")
LOCAL = S.Asked("T2", local=True)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    doc = F.expr("doc_id div 10")
    own = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), doc.alias("doc_id"), (F.col("doc_id") % 10).alias("position"), (F.coalesce("n_chars", F.lit(0)) / 1000.0).alias("x"), ((F.col("doc_id") * 37 % 101) / 101.0).alias("y"))
    return own.withColumns(
        {
            "title": F.concat(F.lit("T"), F.col("doc_id") % 7), "level": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "effect_rank": F.col("doc_id") % 6, "relation": F.col("doc_id") % 4, "local": F.col("doc_id") % 3 == 0,
            "jurisdiction_rank": F.col("doc_id") % 5, "refs": F.array(F.concat(F.lit("D"), F.col("chunk_id") % 9), F.concat(F.lit("D"), F.col("chunk_id") % 13), F.lit("D1")),
        }
    )


def _search(spark: SparkSession, d: str, asked: S.Asked) -> DataFrame:
    own = _chunks(spark, d)
    documents = own.groupBy("doc_id", "title", "level", "effect_rank", "relation", "local", "jurisdiction_rank").agg(F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("y"), 6).alias("y"))
    of = lambda df, id_, score: df.select(id_, F.col(score).alias("score"))
    listed = S.shortlist(of(documents, "doc_id", "y"), of(documents, "doc_id", "x"), documents.drop("x", "y"), asked)
    candidates = S.candidate_chunks(own, listed)
    first = own.filter("position = 0").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"), "chunk_id")
    return S.search(candidates, of(candidates, "chunk_id", "y"), of(candidates, "chunk_id", "x"), first, asked, 20)


QUERIES = {"statute_search": lambda s, d: _search(s, d, ASKED), "statute_search_local": lambda s, d: _search(s, d, LOCAL)}

_OWN = """own AS (SELECT doc_id AS chunk_id, doc_id // 10 AS doc_id, coalesce(n_chars, 0) / 1000e0 AS x, (doc_id * 37 % 101) / 101e0 AS y, doc_id % 10 AS position,
 'T' || (doc_id // 10 % 7) AS title, CASE WHEN doc_id // 10 % 2 = 0 THEN 'a' ELSE 'b' END AS level, doc_id // 10 % 6 AS effect_rank, doc_id // 10 % 4 AS relation, doc_id // 10 % 3 = 0 AS local, doc_id // 10 % 5 AS rank FROM documents)"""


def _fused(table: str, id_: str, k: int) -> str:
    lists = " UNION ALL ".join(f"SELECT {id_}, row_number() OVER (ORDER BY {c} DESC, {id_}) AS r FROM {table} QUALIFY r <= {k}" for c in "yx")
    return f"(SELECT {id_}, round(sum(1e0 / (60 + r)), 9) AS fused FROM ({lists}) GROUP BY {id_})"


def _sql(text: str, authority: bool, local: str, level: str, ranked: str, region: bool) -> str:
    """``local``: the factor of local rows where no region is asked for."""
    hierarchy = "0.12e0 * effect_rank" if authority else "0"
    regional = (
        lambda s, r: f"CASE relation WHEN 3 THEN {s} + 0.22e0 WHEN 2 THEN {s} + 0.14e0 + {r} WHEN 1 THEN {s} + 0.08e0 ELSE {s} * CASE WHEN local THEN 0.45e0 ELSE 1 END END" if region else f"{s} * CASE WHEN local THEN {local} ELSE 1 END"
    )
    named = f"CASE WHEN contains('{text}', title) THEN {{}} ELSE 0 END"
    other = f"level <> '{level}'" if level else "false"
    doc = f"({regional(f'(fused + {hierarchy})', '0')} + {named.format('0.18e0')}) * CASE WHEN {other} THEN 0.5e0 ELSE 1 END"
    chunk = regional(f"(base + {named.format('0.15e0')} + {hierarchy})", ranked)
    return f"""WITH {_OWN}, docs AS (SELECT doc_id, title, level, effect_rank, relation, local, round(sum(x), 6) AS x, round(sum(y), 6) AS y FROM own GROUP BY ALL),
 s AS (SELECT doc_id, score AS doc_score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, {doc} AS score FROM docs JOIN {_fused("docs", "doc_id", 48)} USING (doc_id)) QUALIFY place <= 96),
 c AS (SELECT * FROM own JOIN s USING (doc_id) ORDER BY place, position, chunk_id LIMIT 8000),
 b AS (SELECT c.*, coalesce(fused, 0) + 0.2e0 * doc_score AS base FROM c LEFT JOIN {_fused("c", "chunk_id", 12)} USING (chunk_id)),
 g AS (SELECT chunk_id, CASE WHEN {other} THEN base * 0.5e0 ELSE {chunk} END AS score FROM b
  UNION ALL SELECT first.chunk_id, 0.08e0 * base FROM (SELECT base, unnest([chunk_id % 9, chunk_id % 13]) AS target FROM b WHERE NOT ({other})) JOIN (SELECT chunk_id, doc_id FROM own WHERE position = 0) first ON first.doc_id = target)
 SELECT chunk_id, round(sum(score), 6) AS score FROM g GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20"""


SQL = {"statute_search": _sql(ASKED.text, True, "1", "a", "0.03e0 * rank", True), "statute_search_local": _sql(LOCAL.text, False, "0.76e0", "", "0", False)}
