"""Evaluation queries: answer and tool metrics, paired runs, histograms, gates on hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ._inline import Inline, Spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item is an answer, the document of its id the reference."""
    return _t(spark, d, "benchmark").select("item_id", F.col("text").alias("a")).join(_t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("b")), "item_id")


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("item_id", F.round(T.token_f1(T.word_tokens(F.col("a")), T.word_tokens(F.col("b"))), 6).alias("f1"))


ANSWERS = Spread(
    "id int, answer string, gold string, refs array<string>, trace string, forced boolean, semantic double",
    [
        (1, "应当返还押金。", "应当 返还押金", ["《民法典》第七百零三条"], "Action: rag_search(x)\nObservation: ok\nFinal Answer: yes", False, 0.9),
        (2, "依据《民法典》处理", "不应返还", ["《民法典》", "《刑法》"], "Action: a(x)\nFinal Answer: y", False, 0.85),
        (3, "The deposit goes back to the tenant", "the deposit goes back", [], "Final Answer: z", True, 0.4),
        (4, "", "abc", None, "Action: a(x)\nObservation: ERROR here\nAction: b(y)\nObservation: fine\nFinal Answer: ok", True, 0.1),
        (5, "Yes, it does.", "yes it does", ["no marks"], "Observation: 失败", True, 0.5),
        (6, None, None, ["《立法法》"], "", None, None),
    ], texts=("answer", "gold"))


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = ANSWERS.df(spark, d).select("id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), "trace", F.coalesce("forced", F.lit(False)).alias("forced"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    own = own.select("id", "semantic", T.exact_match(F.col("answer"), F.col("gold")).alias("em"), T.token_f1(T.word_tokens(F.col("answer")), T.word_tokens(F.col("gold"))).alias("f1"), E.citation_hit_rate(F.col("answer"), F.col("refs")).alias("citation_hit_rate"), E.format_compliance(F.col("trace")).alias("format_compliance"), E.error_recovery(F.col("trace"), F.col("forced")).alias("error_recovery"))
    own = own.withColumn("answer_quality", E.answer_quality(F.col("em"), F.col("f1"), F.col("semantic")))
    own = own.withColumn("task_completion", E.task_completion(F.col("answer_quality"), F.col("semantic"), F.col("citation_hit_rate"))).withColumn("tool_use_accuracy", F.lit(None).cast("double"))
    numbers = ("em", "f1", "citation_hit_rate", "format_compliance", "error_recovery", "answer_quality", "task_completion")
    return own.select("id", *(F.round(c, 6).alias(c) for c in numbers), F.round(E.overall(), 6).alias("overall"), E.judge(F.col("em"), F.col("f1"), F.col("citation_hit_rate")).alias("judged"))


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "documents").select("doc_id", "text")
    return own.select("doc_id", T.exact_match(F.col("text"), F.concat(F.lit(" ,"), F.replace("text", F.lit(" "), F.lit("; ")), F.lit("!"))).alias("em"), F.length(T.normalize_answer(F.col("text"))).alias("n"))


def histories(spark: SparkSession, d: str) -> DataFrame:
    """Of each conversation the roles in order, as tools used and, turned about by one, as tools expected."""
    own = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("used"))
    return own.withColumn("expected", F.concat(F.slice("used", F.lit(2), F.size("used")), F.slice("used", 1, 1)))


def tool_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return histories(spark, d).select("conv_id", F.round(E.tool_use_accuracy(F.col("used"), F.col("expected")), 6).alias("accuracy"))


def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each tool, and in how many conversations it is used, with others or alone."""
    own = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("uses"))
    own = own.withColumn("several", F.sum("uses").over(Window.partitionBy("conv_id")) > 1)
    return own.groupBy("role").agg(F.sum("uses").alias("uses"), F.count("*").alias("samples"), F.count_if("several").alias("multi_tool_samples"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples: language is the family, source the strategy; tools grow with length."""
    own = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return own.select("doc_id", "lang", "source", "quality", "toxic", "n_chars", F.when(F.col("n_chars") < 300, 0).when(F.col("n_chars") < 1500, 1).otherwise(2).alias("tools"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    bins = F.when(F.col("tools") == 0, "0").when(F.col("tools") == 1, "1").otherwise("2+")
    own = samples(spark, d).select(F.explode(F.array(F.struct(F.lit("strategy").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("value")), F.struct(F.lit("task").alias("kind"), F.coalesce("lang", F.lit("unknown")).alias("value")), F.struct(F.lit("tools").alias("kind"), bins.alias("value")))).alias("x"), "quality", "toxic")
    return own.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("references"), F.count_if(F.col("toxic") == 1).alias("forced"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A base run and an adapted run of every labelled document, paired by id; a document of odd id has no base citation."""
    own = samples(spark, d).withColumn("length", F.least(F.col("n_chars"), F.lit(2000)) / 2000.0)
    base = own.select("doc_id", (F.col("quality") * 0.5 + F.col("length") * 0.3).alias("b_quality"), F.when(F.col("doc_id") % 2 == 0, F.col("length")).alias("b_tool"), F.col("toxic").cast("double").alias("b_completion"))
    adapted = own.select("doc_id", "lang", (F.col("quality") * 0.6 + F.col("length") * 0.4).alias("a_quality"), F.col("length").alias("a_tool"), (1.0 - F.col("toxic")).alias("a_completion"))
    both = base.join(adapted, "doc_id")
    mean = lambda p: (F.col(p + "_quality") * 0.4 + F.coalesce(F.col(p + "_tool") * 0.15, F.lit(0.0)) + F.col(p + "_completion") * 0.1) / (0.5 + F.when(F.col(p + "_tool").isNotNull(), 0.15).otherwise(0.0))
    return both.withColumn("b_overall", mean("b")).withColumn("a_overall", mean("a"))


METRICS = ("quality", "tool", "completion", "overall")


def adapter_delta(spark: SparkSession, d: str) -> DataFrame:
    """Means, supports and difference of each metric over paired rows; one pass, then unpivoted."""
    one = runs(spark, d).agg(*(f(p + m).alias(f"{k}{p}{m}") for m in METRICS for p in ("b_", "a_") for k, f in (("m_", F.avg), ("n_", F.count))))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{k}{p}{m}").alias(k + p) for p in ("b_", "a_") for k in ("m_", "n_"))) for m in METRICS))).alias("x")
    return one.select(rows).select("x.metric", F.round("x.m_b_", 6).alias("base"), F.col("x.n_b_").alias("n_base"), F.round("x.m_a_", 6).alias("adapted"), F.col("x.n_a_").alias("n_adapted"), F.round(F.col("x.m_a_") - F.col("x.m_b_"), 6).alias("delta"))


def case_studies(spark: SparkSession, d: str) -> DataFrame:
    own = runs(spark, d).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("family"), F.round(E.improvement(), 6).alias("gain"))
    return E.diverse(own, "family", 6, F.desc("gain"), F.asc("doc_id")).select("doc_id", "family", "gain")


def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    own = runs(spark, d).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("family"), F.round("a_completion", 6).alias("completion"), F.round("a_overall", 6).alias("overall"), F.round("a_quality", 6).alias("quality"))
    return E.diverse(own, "family", 2, F.asc("completion"), F.asc("overall"), F.asc("quality"), F.asc("doc_id")).select("doc_id", "family", "completion", "overall", "quality")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation turn with the family and strategy of the document of its conversation's id, or unknown."""
    own = _t(spark, d, "conversations").select("conv_id", "turn").join(_t(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang", "source"), "conv_id", "left")
    return own.select("conv_id", "turn", F.coalesce("lang", F.lit("unknown")).alias("task_family"), F.coalesce("source", F.lit("unknown")).alias("strategy"))


def support(spark: SparkSession, d: str) -> DataFrame:
    """Supports of metrics, and the size of the evaluation inferred from them: the largest count there is, one at least."""
    own = runs(spark, d).agg(F.count("*").alias("n_rows"), F.count("b_tool").alias("n_tool"), F.count("a_quality").alias("n_quality"))
    return own.withColumn("total", F.greatest(F.lit(1).cast("bigint"), "n_rows", "n_tool", "n_quality"))


HITS = Spread(
    "query int, ord int, score double, overlap int",
    [(1, 0, 0.95, 3), (1, 1, 0.9, 0), (1, 2, 0.5, 1), (1, 3, 0.17, 2), (1, 4, 0.2, 1), (2, 0, 0.7, 0), (2, 1, 0.1, 2), (2, 2, 0.13, 0), (3, 0, 0.79, 0), (3, 1, 0.79, 0), (3, 2, 0.72, 0)], ids=("query",))


def hit_gates(spark: SparkSession, d: str) -> DataFrame:
    """Hits that bear on the question (three of a query) and statutes that do (two), in the order given."""
    own = HITS.df(spark, d).withColumn("top", F.max("score").over(Window.partitionBy("query")))
    answers = ((F.col("score") >= 0.18) & (F.col("overlap") >= 1)) | (F.col("score") >= F.greatest(F.lit(0.78), 0.92 * F.col("top")))
    statutes = (F.col("score") >= 0.12) | (F.col("overlap") >= 2)
    parts = [own.filter(gate).withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).filter(F.col("rn") <= n).select("query", "ord", F.lit(name).alias("gate")) for name, gate, n in (("answer", answers, 3), ("statute", statutes, 2))]
    return parts[0].unionByName(parts[1])


def mode_means(spark: SparkSession, d: str) -> DataFrame:
    """Of each language the mean score of its five best documents, by five also where there are fewer, and the sigmoid of its best."""
    own = _t(spark, d, "documents").select("lang", "doc_id", (F.length("text") / 1000.0).alias("score"))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return own.withColumn("rn", rn).filter("rn <= 5").groupBy("lang").agg(F.round(F.sum("score") / 5, 6).alias("mean"), F.round(E.sigmoid(F.max("score")), 6).alias("best"))


QUERIES = {
    "token_f1": token_f1, "exact_match": exact_match, "answer_metrics": answer_metrics, "tool_use_accuracy": tool_accuracy, "tool_usage_stats": tool_usage, "eval_dataset_stats": dataset_stats,
    "base_vs_adapter_delta": adapter_delta, "diverse_cases": case_studies, "failure_cases": failure_cases, "enriched_rows": enriched, "eval_support": support, "hit_gates": hit_gates, "mode_means": mode_means,
}

_TOK = "regexp_extract_all(lower({}), '[0-9a-z_]+')"
_NORM = r"lower(regexp_replace(coalesce({}, ''), '[\s，。、“”‘’：:；;,！!？?（）()【】\[\]《》<>]+', '', 'g'))"


def _f1(a: str, b: str) -> str:
    """F1 of two list columns of DuckDB, by sums over the distinct tokens of both."""
    shared = f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 OR {shared} = 0 THEN 0e0 ELSE 2e0 * ({shared}::DOUBLE / len({a})) * ({shared}::DOUBLE / len({b})) / ({shared}::DOUBLE / len({a}) + {shared}::DOUBLE / len({b})) END"


_ANSWERS = rf"""m AS (SELECT id, coalesce(semantic, 0) AS semantic, coalesce(answer, '') AS answer, coalesce(refs, []) AS refs, trace, coalesce(forced, false) AS forced,
  {_NORM.format('answer')} AS na, {_NORM.format('gold')} AS ng, {_TOK.format("coalesce(answer, '')")} AS ta, {_TOK.format("coalesce(gold, '')")} AS tg FROM {ANSWERS.sql}),
x AS (SELECT id, semantic, CASE WHEN na <> '' AND na = ng THEN 1e0 ELSE 0e0 END AS em, {_f1('ta', 'tg')} AS f1,
  CASE WHEN len(refs) > 0 THEN len(list_filter(refs, lambda r: regexp_extract(r, '《[^》]*》') <> '' AND contains(answer, regexp_extract(r, '《[^》]*》'))))::DOUBLE / len(refs) END AS citation_hit_rate,
  CASE WHEN NOT contains(trace, 'Final Answer:') THEN 0e0 WHEN len(regexp_extract_all(trace, '(?m)^Action:')) = 0 OR len(regexp_extract_all(trace, '(?m)^Observation:')) >= len(regexp_extract_all(trace, '(?m)^Action:')) THEN 1e0 ELSE 0e0 END AS format_compliance,
  CASE WHEN forced THEN CASE WHEN regexp_matches(trace, '(?is)^.*(error|失败)') AND contains(regexp_extract(trace, '(?is)^.*((error|失败).*)$', 1), 'Action:') AND contains(regexp_extract(trace, '(?is)^.*((error|失败).*)$', 1), 'Final Answer:') THEN 1e0 ELSE 0e0 END END AS error_recovery FROM m),
y AS (SELECT *, 0.25e0 * em + 0.35e0 * f1 + 0.40e0 * semantic AS answer_quality FROM x),
z AS (SELECT *, CASE WHEN answer_quality >= 0.68e0 OR (semantic >= 0.82e0 AND coalesce(citation_hit_rate, 0) > 0) THEN 1e0 ELSE 0e0 END AS task_completion FROM y)"""
_HIST = "h AS (SELECT conv_id, list(role ORDER BY turn, role) AS u FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, u, list_concat(u[2:], u[1:1]) AS e FROM h)"
_SAM = "s AS (SELECT doc_id, lang, source, quality, toxic, n_chars, CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 1500 THEN 1 ELSE 2 END AS tools FROM labels JOIN documents USING (doc_id))"
_RUN = f"""{_SAM}, l AS (SELECT *, least(n_chars, 2000) / 2000e0 AS length FROM s),
r AS (SELECT doc_id, lang, quality * 0.5e0 + length * 0.3e0 AS b_quality, CASE WHEN doc_id % 2 = 0 THEN length END AS b_tool, toxic::DOUBLE AS b_completion, quality * 0.6e0 + length * 0.4e0 AS a_quality, length AS a_tool, 1e0 - toxic AS a_completion FROM l),
o AS (SELECT *, (b_quality * 0.4e0 + coalesce(b_tool * 0.15e0, 0e0) + b_completion * 0.1e0) / (0.5e0 + CASE WHEN b_tool IS NULL THEN 0e0 ELSE 0.15e0 END) AS b_overall, (a_quality * 0.4e0 + a_tool * 0.15e0 + a_completion * 0.1e0) / (0.5e0 + 0.15e0) AS a_overall FROM r)"""


def _diverse(source: str, columns: str, order: str, n: int) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {order}) AS k FROM ({source})) ORDER BY (k > 1)::INT, {order} LIMIT {n}"


_PADDED = "' ,' || replace(text, ' ', '; ') || '!'"
SQL = {
    "token_f1": f"WITH p AS (SELECT item_id, {_TOK.format('b.text')} AS a, {_TOK.format('d.text')} AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) SELECT item_id, round({_f1('a', 'b')}, 6) AS f1 FROM p",
    "exact_match": f"SELECT doc_id, CASE WHEN a <> '' AND a = b THEN 1e0 ELSE 0e0 END AS em, length(a)::INT AS n FROM (SELECT doc_id, {_NORM.format('text')} AS a, {_NORM.format(_PADDED)} AS b FROM documents)",
    "answer_metrics": f"WITH {_ANSWERS} SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("em", "f1", "citation_hit_rate", "format_compliance", "error_recovery", "answer_quality", "task_completion")) + ", round((answer_quality * 0.4e0 + coalesce(citation_hit_rate * 0.15e0, 0) + format_compliance * 0.1e0 + task_completion * 0.1e0 + coalesce(error_recovery * 0.1e0, 0)) / (0.4e0 + CASE WHEN citation_hit_rate IS NULL THEN 0e0 ELSE 0.15e0 END + 0.1e0 + 0.1e0 + CASE WHEN error_recovery IS NULL THEN 0e0 ELSE 0.1e0 END), 6) AS overall, em > 0 OR f1 >= 0.55e0 OR (f1 >= 0.35e0 AND coalesce(citation_hit_rate, 0) > 0) AS judged FROM z",
    "tool_use_accuracy": f"WITH {_HIST} SELECT conv_id, round(0.6e0 * len(list_filter(range(1, len(u) + 1), lambda i: u[i] = e[i])) / len(e) + 0.4e0 * ({_f1('u', 'e')}), 6) AS accuracy FROM k",
    "tool_usage_stats": "WITH c AS (SELECT conv_id, role, count(*) AS uses FROM conversations GROUP BY conv_id, role), s AS (SELECT *, sum(uses) OVER (PARTITION BY conv_id) > 1 AS several FROM c) SELECT role, sum(uses)::BIGINT AS uses, count(*)::BIGINT AS samples, count(*) FILTER (several)::BIGINT AS multi_tool_samples FROM s GROUP BY role",
    "eval_dataset_stats": f"WITH {_SAM}, x AS (SELECT 'strategy' AS kind, coalesce(source, 'unknown') AS value, quality, toxic FROM s UNION ALL SELECT 'task', coalesce(lang, 'unknown'), quality, toxic FROM s UNION ALL SELECT 'tools', CASE WHEN tools = 0 THEN '0' WHEN tools = 1 THEN '1' ELSE '2+' END, quality, toxic FROM s) SELECT kind, value, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS \"references\", count(*) FILTER (toxic = 1)::BIGINT AS forced FROM x GROUP BY kind, value",
    "base_vs_adapter_delta": f"WITH {_RUN} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg(b_{m}), 6) AS base, count(b_{m})::BIGINT AS n_base, round(avg(a_{m}), 6) AS adapted, count(a_{m})::BIGINT AS n_adapted, round(avg(a_{m}) - avg(b_{m}), 6) AS delta FROM o" for m in METRICS),
    "diverse_cases": f"WITH {_RUN} " + _diverse("SELECT doc_id, coalesce(lang, 'unknown') AS family, round(1.5e0 * (a_overall - b_overall) + 1.0e0 * (a_completion - b_completion) + 0.5e0 * (a_quality - b_quality) + 0.25e0 * (a_tool - coalesce(b_tool, 0)), 6) AS gain FROM o", "doc_id, family, gain", "gain DESC, doc_id", 6),
    "failure_cases": f"WITH {_RUN} " + _diverse("SELECT doc_id, coalesce(lang, 'unknown') AS family, round(a_completion, 6) AS completion, round(a_overall, 6) AS overall, round(a_quality, 6) AS quality FROM o", "doc_id, family, completion, overall, quality", "completion, overall, quality, doc_id", 2),
    "enriched_rows": "SELECT conv_id, turn, coalesce(lang, 'unknown') AS task_family, coalesce(source, 'unknown') AS strategy FROM conversations LEFT JOIN documents ON doc_id = conv_id",
    "eval_support": f"WITH {_RUN} SELECT count(*)::BIGINT AS n_rows, count(b_tool)::BIGINT AS n_tool, count(a_quality)::BIGINT AS n_quality, greatest(1, count(*), count(b_tool), count(a_quality))::BIGINT AS total FROM o",
    "hit_gates": f"WITH h AS (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM {HITS.sql}), a AS (SELECT query, ord, 'answer' AS gate FROM h WHERE (score >= 0.18e0 AND overlap >= 1) OR score >= greatest(0.78e0, 0.92e0 * top) QUALIFY row_number() OVER (PARTITION BY query ORDER BY ord) <= 3), b AS (SELECT query, ord, 'statute' AS gate FROM h WHERE score >= 0.12e0 OR overlap >= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY ord) <= 2) SELECT * FROM a UNION ALL SELECT * FROM b",
    "mode_means": "WITH s AS (SELECT lang, doc_id, length(text) / 1000e0 AS score FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 5) SELECT lang, round(sum(score) / 5, 6) AS mean, round(CASE WHEN max(score) > 15 THEN 0.99e0 WHEN max(score) < -15 THEN 0.01e0 ELSE 1 / (1 + exp(-max(score))) END, 6) AS best FROM s GROUP BY lang",
}
