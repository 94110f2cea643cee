"""Region and catalogue queries; rows in Chinese are written here, the hierarchy of the tables stands for a region tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import places as P
from ..store import materialise
from ._inline import Inline, Spread, strings


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TREE = Inline(
    "code string, name string, parent string",
    [("43", "湖南省", None), ("4301", "长沙市", "43"), ("430102", "芙蓉区", "4301"), ("430105", "开福区", "4301"), ("4302", "株洲市", "43"), ("11", "北京市", None), ("1101", "市辖区", "11"), ("110101", "东城区", "1101"), ("45", "广西壮族自治区", None), ("4501", "南宁市", "45"), ("36", "江西省", None), ("3601", "开福市", "36"), ("9", "坏", None), ("99", "", None), ("8801", "孤市", "88")],
)
QUESTIONS = Spread("id int, text string", [(1, "长沙市芙蓉区的房东不退押金怎么办"), (2, "湖南与北京的规定"), (3, "开福区"), (4, "开福"), (5, "没有地名"), (6, ""), (7, "广西南宁和湖南株洲以及长沙开福区和北京市东城区")], texts=("text",))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The rows above, and regions, nations and their suppliers (by the last two digits of the key) as provinces, cities and districts; every seventh district has no name of its own."""
    number = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    region = _t(spark, d, "region").select(F.concat(F.lit("5"), F.col("r_regionkey").cast("string")).alias("code"), F.concat("r_name", F.lit("省")).alias("name"), F.lit(None).cast("string").alias("parent"))
    up = F.concat(F.lit("5"), F.col("n_regionkey").cast("string"))
    nation = _t(spark, d, "nation").select("n_nationkey", F.concat(up, number("n_nationkey")).alias("code"), F.concat("n_name", F.lit("市")).alias("name"), up.alias("parent"))
    k = F.col("k")
    county = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 100).alias("k")).distinct().join(nation.select("n_nationkey", F.col("code").alias("parent")), "n_nationkey")
    county = county.select(F.concat("parent", number("k")).alias("code"), F.when(k % 7 == 0, "市辖区").otherwise(F.concat(F.lit("C"), k.cast("string"), F.lit("区"))).alias("name"), "parent")
    return TREE.df(spark).unionByName(region).unionByName(nation.drop("n_nationkey")).unionByName(county)


def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    regions = materialise(P.flatten(nodes(spark, d)), "region-paths")
    return regions, P.mentions(QUESTIONS.df(spark, d), P.aliases(regions), "id", "text")


def tree(spark: SparkSession, d: str) -> DataFrame:
    return P.flatten(nodes(spark, d)).select("code", "name", F.array_join("path_codes", "/").alias("codes"), F.array_join(P.compact_path(F.col("path_names")), "/").alias("names"), P.strip_suffix(F.col("name")).alias("short"))


def region_aliases(spark: SparkSession, d: str) -> DataFrame:
    return P.aliases(P.flatten(nodes(spark, d)))


def text_match(spark: SparkSession, d: str) -> DataFrame:
    regions, found = _mentions(spark, d)
    return P.deepest(found, regions, "id").select("id", "code", "rank")


def alias_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """First words of part names that one brand alone has."""
    own = _t(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.element_at(F.split("p_name", " "), 1).alias("short"), "p_brand", "p_size").groupBy("short", "p_size").agg(F.count("*").alias("n"), F.min("p_brand").alias("brand"))
    return own.filter("n = 1").select("short", "p_size", "brand")


def part_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds a word of the list: the words of each name meet it by an equi-join."""
    words = spark.createDataFrame([("widget", 1), ("gear", 2), ("bolt", 3), ("cold", 4)], "word string, code int")
    own = _t(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return own.join(F.broadcast(words), "word").groupBy("p_partkey").agg(F.count("*").alias("n"), F.max("code").alias("code"))  # words: four rows


#: Regions asked for: a region and nation of the tables, by their keys.
ASKED = ((1,), (2, 7))


def region_relation(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the best relation of its path (region, nation, itself) to those asked for; every third customer is known by its nation only."""
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    own = _t(spark, d, "customer").join(nation, "c_nationkey")
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    path = F.array_compact(F.array(text("R", "n_regionkey"), F.when(F.col("c_custkey") % 5 != 0, text("N", "c_nationkey")), F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_custkey") % 5 != 0), text("C", "c_custkey"))))
    asked = [F.array(*(F.lit(f"{k}{v}") for k, v in zip("RN", a))) for a in ASKED]
    best = F.greatest(*(P.relation(a, path) for a in asked))
    return own.select("c_custkey", F.get(F.array(*map(F.lit, P.RELATIONS)), best).alias("relation"))


RULES = Spread(
    "id int, title string, category string, region string",
    [(1, "宪法", "宪法", None), (2, "湖南省条例", "地方性法规", "43"), (3, "长沙市办法", "地方法规", "4301"), (4, "无地条例", "地方性法规", None), (5, "芙蓉区规定", "nan", "430102"), (6, "解释", " 司法解释 ", None), (7, "北京办法", "行政法规", "11"), (8, "其他", None, None)], )


def jurisdictions(spark: SparkSession, d: str) -> DataFrame:
    scope = P.jurisdiction(F.col("category"), F.col("region"))
    level = P.effect_level(F.coalesce("category", F.lit("")))
    return RULES.df(spark, d).select("id", level.alias("level"), P.effect_rank(level).alias("rank"), scope.alias("scope"), P._of(scope, P.JURISDICTION, 0).alias("scope_rank"))


CATALOG = Inline("title string, category string", [("《中华人民共和国民法典》", "法律"), ("中华人民共和国刑法", "法律"), ("湖南省实施办法", "地方性法规"), ("最高人民法院关于审理买卖合同纠纷案件适用法律问题的解释", "司法解释"), ("不存在的法", None), ("  ", "法律")])
FILES = Inline("title string, version string, path string", [("中华人民共和国民法典", "20200528", "a_20200528.docx"), ("中华人民共和国民法典", "20210101", "a_20210101.docx"), ("中华人民共和国刑法", None, "b.docx"), ("最高人民法院关于审理买卖合同纠纷案件适用法律问题解释", "20210101", "c_20210101.docx"), ("无目录的法", None, "d.docx"), ("湖南省实施细则", None, "e.docx")])
#: The same over the documents, each under a path of its own.
VERSIONS = Spread(FILES.schema, FILES.rows, ids=(), texts=("path",))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return P.manifest(CATALOG.df(spark), FILES.df(spark)).select("key", "effect_level", "effect_rank", "status", "path", "version")


def latest(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_versions(VERSIONS.df(spark, d))


#: The same by hand: one title lacks a character of a listed one and is taken for it, and is listed itself as well.
_MANIFEST = [
    ("中华人民共和国民法典", "法律", 3, "matched", "a_20210101.docx", "20210101"), ("中华人民共和国刑法", "法律", 3, "matched", "b.docx", None), ("湖南省实施办法", "法规", 2, "missing_docx", None, None), ("最高人民法院关于审理买卖合同纠纷案件适用法律问题的解释", "司法解释", 1, "matched", "c_20210101.docx", "20210101"), ("不存在的法", "未知", 0, "missing_docx", None, None),
    ("最高人民法院关于审理买卖合同纠纷案件适用法律问题解释", "未知", 0, "missing_catalog", "c_20210101.docx", "20210101"), ("无目录的法", "未知", 0, "missing_catalog", "d.docx", None), ("湖南省实施细则", "未知", 0, "missing_catalog", "e.docx", None),
]


def titles(spark: SparkSession, d: str) -> DataFrame:
    own = VERSIONS.df(spark, d).select(F.col("path"), F.concat(F.lit("《"), "title", F.lit("》_20200101")).alias("raw"), "title")
    return own.select("path", T.normalize_title(F.col("raw")).alias("marked"), F.array_join(T.title_aliases(F.col("title")), "|").alias("aliases"), F.array_join(T.cross_references(F.concat(F.lit("见《"), "title", F.lit("》和《民法典》及《"), "title", F.lit("》")), ), "|").alias("refs"))


QUERIES = {
    "region_tree": tree, "region_aliases": region_aliases, "region_text_match": text_match, "alias_uniqueness": alias_uniqueness, "part_mentions": part_mentions, "region_relation": region_relation, "jurisdictions": jurisdictions,
    "manifest_titles": manifest, "latest_version": latest, "title_aliases": titles,
}

_SHORT = "CASE " + " ".join(f"WHEN suffix(name, '{s}') AND length(name) >= {len(s) + 2} THEN left(name, length(name) - {len(s)})" for s in P.SUFFIXES) + " END"
_NODES = f"""(SELECT * FROM {TREE.sql} UNION ALL SELECT '5' || r_regionkey, r_name || '省', NULL FROM region UNION ALL SELECT '5' || n_regionkey || lpad(n_nationkey::VARCHAR, 2, '0'), n_name || '市', '5' || n_regionkey FROM nation
UNION ALL SELECT DISTINCT '5' || n_regionkey || lpad(n_nationkey::VARCHAR, 2, '0') || lpad((s_suppkey % 100)::VARCHAR, 2, '0'), CASE WHEN (s_suppkey % 100) % 7 = 0 THEN '市辖区' ELSE 'C' || (s_suppkey % 100) || '区' END, '5' || n_regionkey || lpad(n_nationkey::VARCHAR, 2, '0') FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_TREE = f"RECURSIVE t AS (SELECT * FROM {_NODES} WHERE length(code) IN (2, 4, 6) AND name <> ''), r AS (SELECT code, name, [code] AS codes, [name] AS names FROM t WHERE parent IS NULL UNION ALL SELECT t.code, t.name, list_append(r.codes, t.code), list_append(r.names, t.name) FROM t JOIN r ON t.parent = r.code), s AS (SELECT code, {_SHORT} AS alias FROM r), a AS (SELECT name AS alias, code FROM r UNION SELECT alias, min(code) FROM s WHERE alias IS NOT NULL GROUP BY alias HAVING count(*) = 1)"
_NORMAL = r"(CASE WHEN starts_with(x, '《') AND suffix(x, '》') THEN trim(x[2:-2]) ELSE x END)"
_ALIAS = "CASE WHEN starts_with(title, '中华人民共和国') AND length(title) > 7 THEN title || '|' || substring(title, 8) ELSE title END"
SQL = {
    "region_tree": f"WITH {_TREE} SELECT code, name, array_to_string(codes, '/') AS codes, array_to_string(list_filter(names, lambda x: NOT list_contains({strings(P.PLACEHOLDERS)}, x)), '/') AS names, {_SHORT} AS short FROM r",
    "region_aliases": f"WITH {_TREE} SELECT * FROM a",
    "region_text_match": f"WITH {_TREE}, m AS (SELECT DISTINCT q.id, a.code, codes FROM {QUESTIONS.sql} q JOIN a ON contains(q.text, a.alias) JOIN r ON r.code = a.code) SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY len(codes) DESC, code)::INT AS rank FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.id = m.id AND n.code <> m.code AND list_contains(n.codes, m.code)) QUALIFY rank <= 3",
    "alias_uniqueness": "SELECT string_split(p_name, ' ')[1] AS short, p_size, min(p_brand) AS brand FROM part GROUP BY 1, 2 HAVING count(*) = 1",
    "part_mentions": "SELECT p_partkey, count(DISTINCT word)::BIGINT AS n, max(CASE word WHEN 'widget' THEN 1 WHEN 'gear' THEN 2 WHEN 'bolt' THEN 3 ELSE 4 END)::INT AS code FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word IN ('widget', 'gear', 'bolt', 'cold') GROUP BY p_partkey",
    "region_relation": "WITH p AS (SELECT c_custkey, n_regionkey AS r, n_nationkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey), x AS (SELECT c_custkey, greatest(CASE WHEN r <> 1 THEN 0 WHEN depth = 1 THEN 3 ELSE 1 END, CASE WHEN depth = 1 AND r = 2 THEN 2 WHEN depth = 2 AND n = 7 THEN 3 WHEN depth = 3 AND n = 7 THEN 1 ELSE 0 END) AS best FROM p) SELECT c_custkey, ['none', 'descendant', 'ancestor', 'exact'][best + 1] AS relation FROM x",
    "jurisdictions": f"WITH r AS (SELECT *, trim(coalesce(category, '')) AS c FROM {RULES.sql}), l AS (SELECT id, CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in P.EFFECT.items()) + f" ELSE '未知' END AS level, CASE WHEN NOT (list_contains({strings(P.LOCAL)}, c) OR (region IS NOT NULL AND c IN ('', 'nan', 'none'))) THEN 'national' WHEN region IS NULL THEN 'local_unknown' WHEN length(region) = 2 THEN 'province' WHEN length(region) = 4 THEN 'prefecture' ELSE 'county' END AS scope FROM r) SELECT id, level, CASE level WHEN '宪法' THEN 4 WHEN '法律' THEN 3 WHEN '法规' THEN 2 WHEN '司法解释' THEN 1 ELSE 0 END AS rank, scope, CASE scope WHEN 'national' THEN 4 WHEN 'province' THEN 3 WHEN 'prefecture' THEN 2 WHEN 'county' THEN 1 ELSE 0 END AS scope_rank FROM l",
    "manifest_titles": "SELECT * FROM " + Inline("key string, effect_level string, effect_rank int, status string, path string, version string", _MANIFEST).sql,
    "latest_version": f"SELECT title AS key, arg_max(path, coalesce(version, '') || path) AS path, max(version) AS version FROM {VERSIONS.sql} GROUP BY title",
    "title_aliases": f"SELECT path, title AS marked, {_ALIAS} AS aliases, CASE WHEN title = '民法典' THEN title ELSE title || '|民法典' END AS refs FROM {VERSIONS.sql}",
}
