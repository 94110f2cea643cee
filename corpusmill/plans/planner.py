"""Planner queries: intents and slots of messages, an agent's steps, routing, calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requests as Q
from ..functions import text as T
from ._inline import Inline, Spread, strings

LEGAL, GENERAL = ("法", "合同", "押金", "犯罪", "诉讼"), ("天气", "你好", "电影")
MESSAGES = Spread(
    "id int, text string, active boolean, weak array<string>",
    [
        (1, "给我出题，来10题民法真题", False, []), (2, "生成学习报告", False, ["刑诉"]), (3, "1. A\n2. B", True, []), (4, "1. A", False, []), (5, "我叫小明，我在备考", False, []), (6, "赔偿 3000 元是多少", False, []), (7, "押金不退怎么办", False, ["民诉"]), (8, "今天天气如何", False, []),
        (9, "算了", True, []), (10, "", False, []), (11, "随便", False, []), (12, "查看画像并总结", False, []), (13, "来三道题 复习 盗窃 案例", False, []), (14, "我选 B", True, []), (15, "记住我的薄弱点，出题", False, []), (16, "请给99 题 押题 简答", False, []), (17, "停 一下", False, []), (18, "出 25 道 题，第三章专项", False, []), (19, "测试后的诊断报告", False, []),
    ], texts=("text",))


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def intents(spark: SparkSession, d: str) -> DataFrame:
    return MESSAGES.df(spark, d).select("id", Q.intent(F.col("text"), F.col("active"), LEGAL, GENERAL).alias("i")).select("id", "i.intent", "i.score")


def slots(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return MESSAGES.df(spark, d).select("id", Q.topic(q, F.col("weak")).alias("topic"), Q.question_count(q).alias("n"), Q.exam_type(q).alias("exam_type"), Q.question_types(q).alias("types"), Q.report_type(q).alias("report_type"))


def predicates(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return MESSAGES.df(spark, d).select("id", Q.is_stop(q).alias("stop"), Q.is_sheet(q).alias("sheet"), Q.is_followup(q).alias("followup"), Q.is_calculation(q).alias("calculation"), T.contains_any(q, Q.REPORT_REQUEST).alias("report"), T.contains_any(q, Q.EXAM_REQUEST).alias("exam"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Messages as steps of an agent: an action with the text in it, one before or after an answer, thoughts alone, an answer in a fence, and an action that isn't closed."""
    own = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("x"), F.rtrim(F.regexp_replace(F.substring("text", 1, 20), "[^A-Za-zÀ-ÿ ]", ""))).alias("p"), ((F.col("conv_id") * 7 + F.col("turn")) % 6).alias("k"))
    forms = ("Thought: {p}\nAction: rag_search(query=\"{p} (y)\")", "Action: calculator(1+2)\nFinal Answer: {p}", "Final Answer: {p}\nAction: rag_search(x)", "Thought: {p}", "```\nFinal Answer: {p}\nb\n```", "Action: broken({p}")
    filled = [F.replace(F.lit(f), F.lit("{p}"), F.col("p")) for f in forms]
    return own.select("conv_id", "turn", F.get(F.array(*filled), F.col("k").cast("int")).alias("text"))


def react(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).select("conv_id", "turn", Q.react_step(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


def calculator(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the lines of orders, written in ten ways."""
    text = lambda c: F.col(c).cast("bigint").cast("string")
    own = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text("l_quantity").alias("q"), text("l_extendedprice").alias("p"), F.round(F.col("l_discount") * 100).cast("bigint").cast("string").alias("r"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0").alias("t"))
    forms = ("{q}x{p}元", "-（{q}＋{p}）", "{r}％ * {p}", "{q}^2", "{q}倍*2块钱", "{q}万+{r}百", "min({q}, {p})", "{q} % 3", "1，{t}。5－{q}", "{q}//7 ＋ 10÷4")
    filled = []
    for f in forms:
        c = F.lit(f)
        for name in "qprt":
            c = F.replace(c, F.lit("{" + name + "}"), F.col(name))
        filled.append(c)
    return own.select("l_orderkey", "l_linenumber", Q.calculator(F.get(F.array(*filled), (F.col("l_orderkey") % len(forms)).cast("int"))).alias("value"))


def routing(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation was for, by tools that stand for its roles, and whether its last turn waits for the user."""
    tool = F.when(F.col("role") == "system", "profile_view").when(F.col("role") == "user", "calculator").when(F.length("text") % 2 == 0, "rag_search").otherwise("none")
    own = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(tool).alias("tools"), F.max_by("role", "turn").alias("last"))
    return own.select("conv_id", Q.agent_intent(F.col("tools"), F.col("last") == "user").alias("intent"))


def repeated_calls(spark: SparkSession, d: str) -> DataFrame:
    """Turns that say what the same role said before in the conversation (by the digest of the whole text), and those alike to the turn before by .55 of their tokens."""
    own = _t(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("signature"), F.array_distinct(T.word_tokens(F.col("text"))).alias("w"))
    before = Window.partitionBy("conv_id").orderBy("turn")
    own = own.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "signature").orderBy("turn")) > 1).withColumn("p", F.lag("w").over(before))
    alike = F.size(F.array_intersect("w", "p")) / F.greatest(F.size(F.array_union("w", "p")), F.lit(1))
    return own.select("conv_id", "turn", "again", F.coalesce(alike >= 0.55, F.lit(False)).alias("alike"))


QUERIES = {"intent_scores": intents, "exam_slots": slots, "request_predicates": predicates, "react_parse": react, "calculator": calculator, "agent_intent": routing, "repeated_calls": repeated_calls}


def _any(text: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({strings(words)}, lambda w: contains({text}, w))) > 0"


_LINE = r"(?m)^\s*[0-9]+\s*[\.、:：-]"
_B = f"""b AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS x FROM {MESSAGES.sql}),
p AS (SELECT *, {_any('x', Q.STOP)} OR list_contains({strings(Q.STOP_WHOLE)}, x) AS stop, regexp_matches(x, '{_LINE}') OR {_any('x', ('我的答案', '提交答案'))} AS sheet, length(x) <= 80 AND ({_any('x', Q.FOLLOWUP)} OR regexp_matches(x, '{_LINE}') OR list_contains({strings(Q.FOLLOWUP_WHOLE)}, x)) AS followup,
  regexp_matches(x, '[0-9]') AND (regexp_matches(x, '[+\\-*/%()]') OR {_any('x', Q.CALCULATE)}) AS calculation, {_any('x', Q.PROFILE_UPDATE)} AS upd FROM b)"""
_FITS = (
    f"[CASE WHEN {_any('x', Q.PROFILE_VIEW)} THEN struct_pack(s := 0.9e0, o := 0, i := 'profile_lookup') END, CASE WHEN sheet AND active THEN struct_pack(s := 0.95e0, o := -1, i := 'mock_exam_score') END, CASE WHEN NOT sheet AND followup AND active THEN struct_pack(s := 0.7e0, o := -2, i := 'mock_exam_score') END, "
    f"CASE WHEN {_any('x', Q.REPORT)} THEN struct_pack(s := 0.85e0, o := -3, i := 'report_generation') END, CASE WHEN {_any('x', Q.EXAM)} AND NOT upd THEN struct_pack(s := 0.9e0, o := -4, i := 'mock_exam_generate') END, CASE WHEN upd THEN struct_pack(s := 0.95e0, o := -5, i := 'profile_update') END, "
    f"CASE WHEN calculation THEN struct_pack(s := 0.8e0, o := -6, i := 'legal_calculation') END, CASE WHEN followup AND NOT active THEN struct_pack(s := 0.7e0, o := -7, i := 'followup_answer') END]"
)
_OTHER = f"CASE WHEN {_any('text', LEGAL)} THEN struct_pack(s := 0.6e0, o := 0, i := 'legal_qa') WHEN {_any('text', GENERAL)} THEN struct_pack(s := 0.85e0, o := 0, i := 'general_qa') ELSE struct_pack(s := 0.4e0, o := 0, i := 'general_qa') END"
_TOPIC = "CASE " + " ".join(f"WHEN contains(text, '{s}') THEN '{s}'" for s in Q.SUBJECTS) + " " + " ".join(f"WHEN contains(text, '{k}') THEN '{s}'" for k, s in Q.KEYWORD_SUBJECTS.items()) + " ELSE coalesce(weak[1], '综合') END"
_COUNT = r"coalesce(greatest(1, least(20, nullif(regexp_extract(text, '([0-9]{1,2})\s*题', 1), '')::INT)), CASE WHEN contains(text, '题') THEN CASE " + " ".join(f"WHEN contains(text, '{w}') THEN {n}" for w, n in Q.NUMBERS.items()) + r" END END, greatest(1, least(20, nullif(regexp_extract(text, '([0-9]{1,9})\s*(?:道|个)\s*题', 1), '')::INT)), 5)"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '{'|'.join(w)}') THEN '{n}'" for n, w in Q.EXAM_TYPES.items()) + f" ELSE '{Q.EXAM_TYPE}' END"
SQL = {
    "intent_scores": f"WITH {_B}, f AS (SELECT id, CASE WHEN x = '' THEN struct_pack(s := 0e0, o := 0, i := 'legal_qa') WHEN stop THEN struct_pack(s := 0.95e0, o := 0, i := 'stop') ELSE coalesce(list_max(list_filter({_FITS}, lambda y: y IS NOT NULL)), {_OTHER}) END AS b FROM p) SELECT id, b.i AS intent, b.s AS score FROM f",
    "exam_slots": f"WITH {_B} SELECT id, {_TOPIC} AS topic, {_COUNT}::INT AS n, {_KIND} AS exam_type, CASE WHEN {_any('x', ('简答', '主观', '问答'))} THEN 'short_answer' WHEN contains(x, '案例') THEN 'case_analysis' ELSE 'single_choice,short_answer,case_analysis' END AS types, CASE WHEN {_any('lower(text)', ('诊断', '薄弱'))} THEN 'weakness_diagnosis' WHEN {_any('lower(text)', ('测试', 'exam', 'mock'))} THEN 'mock_exam_review' ELSE 'study_progress' END AS report_type FROM b",
    "request_predicates": f"WITH {_B} SELECT id, stop, regexp_matches(text, '{_LINE}') OR {_any('text', ('我的答案', '提交答案'))} AS sheet, followup, regexp_matches(text, '[0-9]') AND (regexp_matches(text, '[+\\-*/%()]') OR {_any('text', Q.CALCULATE)}) AS calculation, {_any('text', Q.REPORT_REQUEST)} AS report, {_any('text', Q.EXAM_REQUEST)} AS exam FROM p",
    "react_parse": """WITH m AS (SELECT conv_id, turn, 'x' || rtrim(regexp_replace(substring(text, 1, 20), '[^A-Za-zÀ-ÿ ]', '', 'g')) AS p, (conv_id * 7 + turn) % 6 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN 'tool' WHEN k IN (2, 4) THEN 'final' ELSE 'invalid' END AS kind, CASE k WHEN 0 THEN 'rag_search' WHEN 1 THEN 'calculator' END AS tool,
CASE k WHEN 0 THEN 'query="' || p || ' (y)"' WHEN 1 THEN '1+2' END AS args, CASE k WHEN 2 THEN p || chr(10) || 'Action: rag_search(x)' WHEN 4 THEN p || chr(10) || 'b' END AS answer FROM m""",
    "calculator": """WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 10 AS k, trunc(l_quantity)::DOUBLE AS q, trunc(l_extendedprice)::DOUBLE AS p, round(l_discount * 100)::DOUBLE AS r, (l_orderkey % 1000)::DOUBLE AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN q * p WHEN 1 THEN -(q + p) WHEN 2 THEN r / 100e0 * p WHEN 3 THEN q * q WHEN 4 THEN q * 2 WHEN 5 THEN q * 10000 + r * 100 WHEN 6 THEN least(q, p) WHEN 8 THEN 1000 + t + 0.5e0 - q WHEN 9 THEN floor(q / 7) + 2.5e0 END AS value FROM l""",
    "agent_intent": "WITH t AS (SELECT conv_id, list(DISTINCT CASE WHEN role = 'system' THEN 'profile_view' WHEN role = 'user' THEN 'calculator' WHEN length(text) % 2 = 0 THEN 'rag_search' ELSE 'none' END) AS tools, arg_max(role, turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN last = 'user' THEN 'clarification' " + " ".join(f"WHEN list_contains(tools, '{t}') THEN '{i}'" for t, i in Q.TOOL_INTENTS) + " ELSE 'legal_qa' END AS intent FROM t",
    "repeated_calls": "WITH c AS (SELECT conv_id, turn, role, md5(text) AS s, list_distinct(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS w FROM conversations), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, s ORDER BY turn) > 1 AS again, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c) SELECT conv_id, turn, again, coalesce(len(list_intersect(w, p))::DOUBLE / greatest(len(list_distinct(list_concat(w, p))), 1) >= 0.55e0, false) AS alike FROM d",
}
