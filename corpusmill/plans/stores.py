"""Queries over sources and stores: broken lines, workbooks, graphs of links, places by their parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import regions as P
from ..sources import quarantine as Q
from ..sources import xlsx as X
from ..store import materialise, shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _planted(spark: SparkSession, d: str) -> str:
    """The documents' numbers as JSON Lines, some of them broken; the folder."""
    own = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    line, k = F.to_json(F.struct("doc_id", "lang", "n_chars")), F.col("doc_id") % 50
    broken = F.when(k == 0, F.substring(line, 1, 10)).when(k == 1, F.concat(F.lit('{"doc_id":"x'), F.col("doc_id").cast("string"), F.lit('","lang":"en"}'))).when(k == 2, F.lit('{"lang":"de","n_chars":1}')).when(k == 3, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    own.select(broken.alias("value")).write.text(path)
    return path


def _ingested(spark: SparkSession, d: str):
    return Q.ingest(spark, _planted(spark, d), "doc_id bigint, lang string, n_chars bigint", "doc_id", f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}")


def quarantine_good(spark: SparkSession, d: str) -> DataFrame:
    return Q.good(spark, _ingested(spark, d)).select("doc_id", "lang", "n_chars")


def quarantine_bad(spark: SparkSession, d: str) -> DataFrame:
    return Q.quarantined(spark, _ingested(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Orders packed into workbooks of 5,000 rows and read out of them again."""
    own = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    return X.unpack(X.pack(own), own.columns)


def links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.col("page_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("target"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").filter("page_id % 50 = 0").select(F.col("page_id").alias("asked"))


def node_view(spark: SparkSession, d: str) -> DataFrame:
    """Of pages whose id is divisible by 50: what they link to, up to ten pages that share a link, and of the vectors nearest to the vector of their number those that are none of these."""
    own, edges = asked(spark, d), materialise(links(spark, d), "links")
    near = materialise(G.related(own, edges, 10), "related")
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    like = G.similar(own.join(vectors.withColumnRenamed("node", "asked"), "asked"), vectors, 3, near)
    row = lambda df, part, node, rank: df.select("asked", F.lit(part).alias("part"), node.cast("string").alias("node"), rank.cast("int").alias("rank"))
    cited = edges.join(own, F.col("source") == F.col("asked"), "left_semi").withColumnRenamed("source", "asked").distinct()
    return row(cited, "cites", F.col("target"), F.lit(0)).unionByName(row(near, "related", F.col("node"), F.col("rank"))).unionByName(row(like, "similar", F.col("node"), F.col("rank")))


def hops(spark: SparkSession, d: str) -> DataFrame:
    """Two steps over links, there and back, along five edges of each node at most."""
    edges = links(spark, d).select(F.concat(F.lit("p"), F.col("source").cast("string")).alias("source"), F.concat(F.lit("/"), "target").alias("target"))
    both = materialise(edges.union(edges.select("target", "source")), "both-ways")
    start = asked(spark, d).select(F.concat(F.lit("p"), F.col("asked").cast("string")).alias("asked"))
    return G.neighbourhood(start, both, 2, 5)


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as provinces, prefectures and counties; ten names are shared by all counties, and Asia names a county as well."""
    region = _t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit("province").alias("level"))
    nation = _t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.lit("prefecture"))
    named = F.when(F.col("s_suppkey") % 13 == 0, "ASIA").otherwise(F.concat(F.lit("c"), (F.col("s_suppkey") % 10).cast("string")))
    county = _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), named, F.lit("county"))
    return region.union(nation).union(county)


def places(spark: SparkSession, d: str) -> DataFrame:
    """Each customer asks for a county's name within its nation, or a wrong one, and within a region that may not fit."""
    nation, region = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _t(spark, d, "region").select("r_regionkey", "r_name")
    own = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, (F.col("n_regionkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)) % 5 == F.col("r_regionkey"))
    k = F.col("c_custkey")
    requests = own.select(k.alias("request"), F.when(k % 3 != 0, F.col("r_name")).alias("province"), F.when(k % 4 != 0, F.col("n_name")).otherwise("").alias("prefecture"), F.when(k % 5 == 0, "ASIA").when(k % 5 < 3, F.concat(F.lit("c"), (k % 11).cast("string"))).alias("county"))
    return P.resolve(requests, materialise(P.labelled(tree(spark, d)), "tree"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """How many regions lie below each, by its interval."""
    own = P.labelled(tree(spark, d))
    return own.select("id", "level", (F.col("leave") - F.col("enter") - 1).alias("below"))


QUERIES = {"quarantine_good": quarantine_good, "quarantine_bad": quarantine_bad, "xlsx_rows": workbooks, "graph_node_view": node_view, "graph_neighbourhood": hops, "location_parts": places, "region_intervals": intervals}

_LINE = """concat('{"doc_id":', doc_id, CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END, CASE WHEN n_chars IS NULL THEN '' ELSE ',"n_chars":' || n_chars END, '}')"""
_EDGE = """e AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)"""
_TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, 'province' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'prefecture' FROM nation
UNION ALL SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0'), 'n' || s_nationkey, CASE WHEN s_suppkey % 13 = 0 THEN 'ASIA' ELSE 'c' || (s_suppkey % 10) END, 'county' FROM supplier)"""
SQL = {
    "quarantine_good": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 50 > 3",
    "quarantine_bad": f"""SELECT reason, count(*)::BIGINT AS n, sum(n)::BIGINT AS chars FROM (SELECT CASE doc_id % 50 WHEN 1 THEN 'wrong_type' WHEN 2 THEN 'no_key' ELSE 'not_json' END AS reason,
CASE doc_id % 50 WHEN 0 THEN 10 WHEN 1 THEN length('{{"doc_id":"x' || doc_id || '","lang":"en"}}') WHEN 2 THEN 25 ELSE length({_LINE}) + 2 END AS n FROM documents WHERE doc_id % 50 < 4) GROUP BY reason""",
    "xlsx_rows": "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus::VARCHAR AS o_orderstatus, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority::VARCHAR AS o_orderpriority FROM orders",
    "graph_node_view": f"""WITH {_EDGE}, a AS (SELECT page_id AS asked FROM pages WHERE page_id % 50 = 0),
m AS (SELECT x.source AS asked, y.source AS node, count(*) AS shared FROM e x JOIN e y USING (target) WHERE x.source % 50 = 0 AND x.source <> y.source GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY shared DESC, node) AS rank FROM m QUALIFY rank <= 10),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT asked, b.vec_id AS node, round(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] * b.v[i])), 6) AS score FROM a JOIN v x ON x.vec_id = asked, v b),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, node) <= 4), k AS (SELECT h.*, row_number() OVER (PARTITION BY asked ORDER BY score DESC, node) AS rank FROM h ANTI JOIN r USING (asked, node) WHERE asked <> node)
SELECT source AS asked, 'cites' AS part, target::VARCHAR AS node, 0::INT AS rank FROM e WHERE source % 50 = 0 UNION ALL SELECT asked, 'related', node::VARCHAR, rank::INT FROM r UNION ALL SELECT asked, 'similar', node::VARCHAR, rank::INT FROM k WHERE rank <= 3""",
    "graph_neighbourhood": f"""WITH {_EDGE}, b AS (SELECT 'p' || source AS source, '/' || target AS target FROM e UNION SELECT '/' || target, 'p' || source FROM e), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 5),
one AS (SELECT source AS asked, target AS node FROM c JOIN pages ON c.source = 'p' || page_id WHERE page_id % 50 = 0), two AS (SELECT DISTINCT asked, c.target AS node FROM one JOIN c ON c.source = one.node WHERE asked <> c.target)
SELECT asked, node, 1::INT AS hop FROM one UNION ALL SELECT asked, node, 2::INT FROM (SELECT * FROM two EXCEPT SELECT * FROM one)""",
    "location_parts": f"""WITH {_TREE}, q AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 3 <> 0 THEN r_name END AS province, CASE WHEN c_custkey % 4 <> 0 THEN n_name ELSE '' END AS prefecture, CASE WHEN c_custkey % 5 = 0 THEN 'ASIA' WHEN c_custkey % 5 < 3 THEN 'c' || (c_custkey % 11) END AS county
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON (n_regionkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 5 = r_regionkey),
n AS (SELECT c.id, c.name, p.name AS up, g.name AS top FROM t c JOIN t p ON c.parent = p.id JOIN t g ON p.parent = g.id WHERE c.level = 'county'),
m AS (SELECT c.id, c.name, p.name AS up FROM t c JOIN t p ON c.parent = p.id WHERE c.level = 'prefecture'),
f AS (SELECT request, 3 AS depth, 'county' AS level, min(n.id) AS id FROM q JOIN n ON n.name = county WHERE coalesce(province, '') IN ('', n.name, up, top) AND coalesce(prefecture, '') IN ('', n.name, up, top) GROUP BY request
UNION ALL SELECT request, 2, 'prefecture', min(m.id) FROM q JOIN m ON m.name = prefecture WHERE coalesce(province, '') IN ('', m.name, up) GROUP BY request
UNION ALL SELECT request, 1, 'province', min(t.id) FROM q JOIN t ON t.name = province AND t.level = 'province' GROUP BY request)
SELECT request, id, level FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY depth DESC) = 1""",
    "region_intervals": f"WITH {_TREE}, c AS (SELECT id, level, (SELECT count(*) FROM t x WHERE x.parent = t.id) + (SELECT count(*) FROM t x JOIN t y ON x.parent = y.id WHERE y.parent = t.id) AS below FROM t) SELECT id, level, below::BIGINT AS below FROM c",
}
