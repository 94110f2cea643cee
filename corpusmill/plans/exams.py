"""Exams for users out of a bank, and searches over several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import banks as B
from ..operators import exams as E
from ..operators import ranking as R
from .indexes import text_index


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KINDS = ("single_choice", "short_answer", "case_analysis")
EXAMS = (E.WEAK, E.CHAPTER, E.PAST, E.MIXED, "其他")


def bank(spark: SparkSession, d: str) -> DataFrame:
    """Parts as questions: the brand is the topic, the tags another brand and the type's first word."""
    key = F.col("p_partkey")
    level = F.when(F.col("p_size") < 15, "easy").when(F.col("p_size") < 35, "medium").otherwise("hard")
    tags = F.array(F.concat(F.lit("Brand#"), (key % 5 + 1).cast("string"), (key % 3 + 1).cast("string")), F.element_at(F.split("p_type", " "), 1))
    return _t(spark, d, "part").select(key.alias("id"), F.get(F.array(*map(F.lit, KINDS)), (key % 3).cast("int")).alias("type"), F.col("p_brand").alias("topic"), tags.alias("tags"), level.alias("difficulty"))


def topic_hits(spark: SparkSession, d: str) -> DataFrame:
    """Fused ranks of two lists for each topic: its forty dearest parts, and its forty of least digest."""
    own = _t(spark, d, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("id"), "p_retailprice", F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("h"))
    parts = None
    for order in (F.desc("p_retailprice"), F.asc("h")):
        rank = F.row_number().over(Window.partitionBy("topic").orderBy(order, "id"))
        part = own.withColumn("rank", rank).filter("rank <= 40").select("topic", "id", (1.0 / (R.RRF_K + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("topic", "id").agg(F.sum("part").alias("rrf"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose number is divisible by 50 ask for exams; profiles by their numbers."""
    k = F.col("c_custkey")
    brand = lambda a, b: F.concat(F.lit("Brand#"), (a % 5 + 1).cast("string"), (b % 5 + 1).cast("string"))
    j = (k / 50).cast("bigint")
    ids = lambda step, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (j * 7 + i * step) % 200 + 1)
    topic = F.when(j % 7 == 0, F.lit(None).cast("string")).when(j % 7 == 1, E.ALL).when(j % 7 == 2, "none").otherwise(brand(j, j + 1))
    types = F.when(j % 4 == 0, F.array(F.lit(KINDS[0]))).when(j % 4 == 1, F.array(F.lit(KINDS[1]), F.lit(KINDS[2]), F.lit(KINDS[1]))).otherwise(F.array(*map(F.lit, KINDS)))
    own = _t(spark, d, "customer").filter(k % 50 == 0)
    return own.select(
        k.alias("request"), topic.alias("topic"), F.get(F.array(*map(F.lit, EXAMS)), (j % 5).cast("int")).alias("exam"), (j % 9 + 1).cast("int").alias("n"), types.alias("types"), F.array(brand(j, j), F.lit("STANDARD")).alias("weak"), F.array(brand(j, j), brand(j + 1, j)).alias("goals"), F.array(brand(j, j + 2), F.lit("PROMO")).alias("strong"),
        ids(3, 30).alias("recent"), ids(11, 6).alias("wrong"), ((j % 10) / 10.0).alias("mastery"), F.concat(F.lit("s"), k.cast("string")).alias("seed"),
    )


def generated(spark: SparkSession, d: str) -> DataFrame:
    return E.sample(E.plan(users(spark, d)), bank(spark, d), topic_hits(spark, d))


#: Sources of the search, hits that it gives, and how many are recalled of each source.
SOURCES, TOP, RECALL = ("en", "de", "fr"), 5, 2
TERMS = ["the", "der", "les", "license", "que"]


def multi_source(spark: SparkSession, d: str) -> DataFrame:
    """Recall by source, lexical hits of all and vectors of two of them; a record in both lists has its larger score times 1.2."""
    lexical = text_index(spark, d).overlap(TERMS, "head").select(F.col("id").alias("doc_id"), F.col("lang").alias("origin"), "score")
    query = _t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(_t(spark, d, "documents").select("doc_id", F.col("lang").alias("origin")), "doc_id")
    return R.search_sources(lexical, R.dense(vectors, query), list(SOURCES), list(SOURCES[:2]), TOP, TOP * RECALL)


TARGET, PREFIX = 900, "gen-"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates: ids collide by the length of the text, questions by its first words."""
    words = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit(PREFIX), (F.col("n_chars") % 5000).cast("string")).alias("id"), F.coalesce("lang", F.lit("xx")).alias("type"), F.coalesce(words, F.lit("")).alias("question"))


def _bank(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the bank so far: half of their ids are generated ones, some hold what candidates hold."""
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(F.concat(F.when(k % 2 == 0, PREFIX).otherwise(F.when(k % 3 == 0, "gen").otherwise("own-")), k.cast("string")).alias("id"), F.lit("en").alias("type"), F.element_at(F.split("p_name", " "), 1).alias("question"), F.col("p_brand").alias("title"))


def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return B.rebuilt_questions(_candidates(spark, d), _bank(spark, d), "doc_id", PREFIX, TARGET)


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as cases, with titles that repeat and that brands have."""
    k = F.col("s_suppkey")
    own = _t(spark, d, "supplier").select(k.alias("at"), F.concat(F.lit("own-"), (k % 70).cast("string")).alias("id"), F.concat(F.lit("Brand#"), (k % 9 + 10).cast("string")).alias("title"), F.concat(F.lit("sample-"), F.lpad(k.cast("string"), 9, "0")).alias("sample"))
    return B.titled_cases(own, _bank(spark, d), "at", "sample").select("id", "title")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return B.summary({n: _t(spark, d, n) for n in ("documents", "part", "supplier", "benchmark")})


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of three languages; the others are left out."""
    return B.flattened(_t(spark, d, "documents").select("doc_id", "lang"), ["fr", "en", "es"], "lang", "doc_id").select("doc_id", "lang", F.col("position").cast("bigint").alias("position"))


QUERIES = {"bank_rebuild": rebuilt, "case_titles": cases, "bank_summary": counts, "pool_order": laid_out, "exam_generation": generated, "multi_source_search": multi_source}
_MAP = lambda column, values, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in values.items()) + f" ELSE {default!r}e0 END"
_U = "(-ln((('0x' || substring(md5(id::VARCHAR || ':' || seed || ':{0}'), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297e0) / {1})"
_W = lambda shun: f"""greatest(0.01e0, ((((CASE WHEN mastery < 0.35e0 THEN {_MAP('difficulty', E.MASTERY[0], 1.0)} WHEN mastery < 0.75e0 THEN {_MAP('difficulty', E.MASTERY[1], 1.0)} ELSE {_MAP('difficulty', E.MASTERY[2], 1.0)} END)
 * (CASE WHEN sem > 0.5e0 THEN 1e0 + (sem - 0.5e0) * 5e0 ELSE 1e0 END) * (CASE WHEN topical AND quality > 0 THEN 1.5e0 ELSE 1e0 END) + pref * (CASE WHEN exam = '{E.WEAK}' THEN 1.4e0 ELSE 0.9e0 END) + (CASE WHEN priority THEN CASE WHEN exam = '{E.WEAK}' THEN 2e0 ELSE 1e0 END ELSE 0e0 END))
 * (CASE WHEN mast > 0 THEN greatest(0.2e0, 1 - 0.18e0 * mast) ELSE 1e0 END)) * (CASE WHEN {shun} THEN CASE WHEN exam = '{E.WEAK}' THEN 0.55e0 ELSE 0.22e0 END ELSE 1e0 END))
 + (CASE exam WHEN '{E.PAST}' THEN {_MAP('difficulty', *E.PAST_BONUS)} WHEN '{E.MIXED}' THEN {_MAP('difficulty', *E.MIXED_BONUS)} ELSE 0e0 END) + (CASE WHEN exam IN ('{E.CHAPTER}', '{E.WEAK}', '{E.PAST}') AND topical THEN 1.1e0 * quality ELSE 0e0 END))"""  # noqa: E731
_B = lambda a, b: f"'Brand#' || (({a}) % 5 + 1) || (({b}) % 5 + 1)"
_IDS = lambda step, n: f"list_transform(range(1, {n + 1}), lambda i: (j * 7 + i * {step}) % 200 + 1)"
SQL = {
    "exam_generation": f"""WITH b AS (SELECT p_partkey AS id, ['single_choice', 'short_answer', 'case_analysis'][(p_partkey % 3 + 1)::INT] AS type, p_brand AS own, ['Brand#' || (p_partkey % 5 + 1) || (p_partkey % 3 + 1), string_split(p_type, ' ')[1]] AS tags, CASE WHEN p_size < 15 THEN 'easy' WHEN p_size < 35 THEN 'medium' ELSE 'hard' END AS difficulty FROM part),
h AS (SELECT topic, id, sum(1e0 / (60 + rank)) * 30 AS sem FROM (SELECT p_brand AS topic, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 40 UNION ALL SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS r2 FROM part QUALIFY r2 <= 40) GROUP BY ALL),
q AS (SELECT c_custkey AS request, c_custkey // 50 AS j FROM customer WHERE c_custkey % 50 = 0),
r AS (SELECT request, CASE j % 7 WHEN 0 THEN NULL WHEN 1 THEN '{E.ALL}' WHEN 2 THEN 'none' ELSE {_B('j', 'j + 1')} END AS topic, {list(EXAMS)!r}[(j % 5 + 1)::INT] AS exam, j % 9 + 1 AS n, CASE j % 4 WHEN 0 THEN ['single_choice'] WHEN 1 THEN ['short_answer', 'case_analysis'] ELSE ['single_choice', 'short_answer', 'case_analysis'] END AS types,
 list_distinct([{_B('j', 'j')}, 'STANDARD', {_B('j + 1', 'j')}]) AS preferred, [{_B('j', 'j + 2')}, 'PROMO'] AS strong, {_IDS(3, 30)} AS recent, {_IDS(11, 6)} AS wrong, (j % 10) / 10e0 AS mastery, 's' || request AS seed FROM q),
s AS (SELECT *, topic IS NOT NULL AND topic <> '{E.ALL}' AS topical, topic IS NOT NULL AND topic <> '{E.ALL}' AND exam IN ('{E.CHAPTER}', '{E.WEAK}', '{E.PAST}') AS strict FROM r),
m AS (SELECT s.*, b.id, difficulty, CASE WHEN NOT topical THEN 0 WHEN own = s.topic THEN 2 WHEN list_contains(tags, s.topic) THEN 1 ELSE 0 END AS quality, len(list_filter(preferred, lambda t: t = own OR list_contains(tags, t))) AS pref, len(list_filter(strong, lambda t: t = own OR list_contains(tags, t))) AS mast, coalesce(sem, 0) AS sem,
 exam = '{E.WEAK}' AND list_contains(wrong, b.id) AS priority, list_contains(recent, b.id) OR (exam <> '{E.WEAK}' AND list_contains(wrong, b.id)) AS avoid FROM s JOIN b ON list_contains(types, b.type) LEFT JOIN h ON h.topic = s.topic AND h.id = b.id),
p AS (SELECT *, CASE WHEN NOT topical THEN true WHEN strict THEN quality = 2 WHEN max(quality) OVER (PARTITION BY request) > 0 THEN quality > 0 ELSE true END AS pool FROM m),
k AS (SELECT request, id, n, exam, seed, strict, topical, quality, priority, avoid, pool, round({_U.format(1, '(' + _W('false') + ' + 2.4e0)')}, 9) AS k1, round({_U.format(2, _W('avoid'))}, 9) AS k2, round({_U.format(3, _W('false'))}, 9) AS k3,
 pool AND priority AND (NOT topical OR quality > 0) AS fits FROM p),
c AS (SELECT *, count(*) FILTER (pool) OVER w AS n_pool, count(*) FILTER (fits) OVER w AS n_fits, count(*) FILTER (priority) OVER w AS n_any FROM k WINDOW w AS (PARTITION BY request)),
d AS (SELECT *, CASE WHEN n_fits > 0 THEN fits ELSE priority END AS lead, CASE WHEN greatest(n_fits, n_any) = 0 THEN 0 ELSE least(CASE WHEN n_fits > 0 THEN n_fits ELSE n_any END, n, greatest(1, round_even(n * {_MAP('exam', E.SHARE, E.OTHER_SHARE)}, 0)::INT)) END AS target FROM c WHERE n_pool > 0),
one AS (SELECT * FROM d WHERE lead QUALIFY row_number() OVER (PARTITION BY request ORDER BY k1, id) <= target),
e AS (SELECT d.*, (SELECT count(*) FROM one WHERE one.request = d.request) AS taken FROM d ANTI JOIN one USING (request, id) WHERE pool),
f AS (SELECT *, count(*) FILTER (NOT avoid) OVER (PARTITION BY request) >= n - taken AS enough FROM e),
two AS (SELECT * FROM f WHERE NOT enough OR NOT avoid QUALIFY row_number() OVER (PARTITION BY request ORDER BY k2, id) <= n - taken),
far AS (SELECT request, id, 1 AS stage, seed FROM one UNION ALL SELECT request, id, 2, seed FROM two),
g AS (SELECT d.*, (SELECT count(*) FROM far WHERE far.request = d.request) AS taken FROM d ANTI JOIN far USING (request, id) WHERE pool OR NOT strict),
three AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request ORDER BY k3, id) <= n - taken),
z AS (SELECT * FROM far UNION ALL SELECT request, id, 3, seed FROM three)
SELECT request, id, stage::INT AS stage, row_number() OVER (PARTITION BY request ORDER BY md5(id::VARCHAR || ':' || seed || ':shuffle'), id)::INT AS place FROM z""",
    "multi_source_search": f"""WITH x AS (SELECT doc_id, lang AS origin, round(len(hit) / {len(TERMS)}e0 + CASE WHEN len(list_filter(hit, lambda t: contains(lower(substring(text, 1, 40)), t))) > 0 THEN 0.1e0 ELSE 0e0 END, 4) AS score FROM (SELECT doc_id, lang, text, list_intersect({TERMS!r}, regexp_extract_all(lower(text), '[0-9a-z_]+')) AS hit FROM documents) WHERE len(hit) > 0 AND lang IN {SOURCES!r}),
a AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY origin ORDER BY score DESC, doc_id) <= {TOP * RECALL}),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), y AS (SELECT vec_id AS doc_id, lang AS origin, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::DOUBLE * q[i])), 6) AS score FROM embeddings JOIN documents ON vec_id = doc_id, q WHERE lang IN {SOURCES[:2]!r}),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY origin ORDER BY score DESC, doc_id) <= {TOP * RECALL})
SELECT doc_id, coalesce(a.origin, b.origin) AS origin, round(CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN greatest(a.score, b.score) * 1.2e0 ELSE coalesce(a.score, b.score) END, 6) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT {TOP}""",
    "bank_rebuild": """WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, 'gen-' || (n_chars % 5000) AS id, coalesce(lang, 'xx') AS type, coalesce(array_to_string(string_split(text, ' ')[1:2], ' '), '') AS question FROM documents),
b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'gen-' WHEN p_partkey % 3 = 0 THEN 'gen' ELSE 'own-' END || p_partkey AS id, 'en' AS type, string_split(p_name, ' ')[1] AS question FROM part), k AS (SELECT * FROM b WHERE NOT starts_with(id, 'gen-')),
w(pos, ids, keys, id, type, question, ok) AS (SELECT 0::BIGINT, (SELECT list(id) FROM k), (SELECT list(type || '::' || question) FROM k), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false
UNION ALL SELECT pos, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(keys, type || '::' || question) ELSE keys END, id, type, question, ok
FROM (SELECT c.pos, ids, keys, c.id, c.type, c.question, NOT list_contains(ids, c.id) AND NOT list_contains(keys, c.type || '::' || c.question) AS ok FROM w JOIN c ON c.pos = w.pos + 1))
SELECT id, type, question, false AS generated FROM k UNION ALL (SELECT id, type, question, true FROM w WHERE ok ORDER BY pos LIMIT (SELECT greatest(0, 900 - count(*)) FROM k))""",
    "case_titles": """WITH b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'gen-' WHEN p_partkey % 3 = 0 THEN 'gen' ELSE 'own-' END || p_partkey AS id, p_brand AS title FROM part),
c AS (SELECT s_suppkey AS pos, 'own-' || (s_suppkey % 70) AS id, 'Brand#' || (s_suppkey % 9 + 10) AS title, lpad(s_suppkey::VARCHAR, 9, '0') AS s FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY s_suppkey) = 1), o AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM b))
SELECT id, CASE WHEN row_number() OVER (PARTITION BY title ORDER BY pos) > 1 OR title IN (SELECT title FROM b) THEN title || '（' || right(s, 6) || '）' ELSE title END AS title FROM o""",
    "bank_summary": "SELECT 'documents' AS bank, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'benchmark', count(*) FROM benchmark",
    "pool_order": "SELECT doc_id, lang, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id) - 1 AS position FROM documents WHERE lang IN ('fr', 'en', 'es')",
}
