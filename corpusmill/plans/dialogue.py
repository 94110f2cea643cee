"""An agent's dialogue: facts supplied, clarifications, reviews of drafts, tools to go on with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialogue as D
from ._inline import Every, Inline, strings

TURNS = Every(
    "id int, role string, question string",
    [
        (1, "supplement", "原始法律问题：押金能退吗\n已补充事实：\n- 租期是多少：2年\n- 金额是3000元\n\n- 地址:"),
        (2, "correction", "是的"),
        (3, "supplement", "12"),
        (4, "new_question", "12"),
        (5, "answer_to_followup", "abc def ghi"),
        (6, "supplement", ""),
        (7, None, None),
        (8, "supplement", "已补充事实：\n所在地：长沙"),
    ], ids=('id',))
#: By hand: first question, prompts and answers, whether the turn is a meaningful answer, numbers.
_FACTS = [
    (1, "押金能退吗", "租期是多少=2年|=金额是3000元|=地址:", True, 2),
    (2, "是的", "", False, 0),
    (3, "12", "", True, 1),
    (4, "12", "", False, 1),
    (5, "abc def ghi", "", True, 0),
    (6, "", "", False, 0),
    (7, "", "", False, 0),
    (8, "已补充事实：\n所在地：长沙", "=所在地：长沙", True, 0),
]
CLARIFICATIONS = Every(
    "id int, question string",
    [(1, "是否已经签订合同"), (2, '{"question": "合同金额是多少"}'), (3, "question: “何时到期”"), (4, ""), (5, None), (6, "提供收据\n\n 和发票 "), (7, "question=哪一方违约, field_name=party"), (8, "确认完毕！"), (9, "{金额}")], ids=('id',))
_CLARIFIED = [(1, "是否已经签订合同？"), (2, "合同金额是多少。"), (3, "何时到期？"), (4, D.DEFAULT_CLARIFICATION), (5, D.DEFAULT_CLARIFICATION), (6, "提供收据\n和发票。"), (7, "哪一方违约？"), (8, "确认完毕！"), (9, "金额。")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def supplied(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    pairs = F.array_join(F.transform(D.supplied_facts(q), lambda p: F.concat(p["prompt"], F.lit("="), p["answer"])), "|")
    return TURNS.df(spark, d).select("id", D.root_question(q).alias("root"), pairs.alias("pairs"), D.meaningful_answer(F.col("role"), q).alias("meaningful"), D.number_count(q).alias("numbers"))


def clarifications(spark: SparkSession, d: str) -> DataFrame:
    return CLARIFICATIONS.df(spark, d).select("id", D.clarification(F.col("question")).alias("question"))


def fallback(spark: SparkSession, d: str) -> DataFrame:
    """The tool to go on with of each conversation: user turns count as context prepared, assistants' as searches; the role of the last turn stands for the step recommended."""
    tool = F.when(F.col("role") == "system", "prepare_context").when(F.col("role") == "assistant", "rag_search").otherwise("none")
    own = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(tool).alias("used"), F.max_by("role", "turn").alias("last"), F.count("*").alias("n"))
    step = F.when(F.col("last") == "user", "rag_search").when(F.col("last") == "assistant", "finish")
    return own.select("conv_id", D.fallback_tool(step, F.when(F.col("n") % 2 == 0, "legal_qa").otherwise("chat"), F.col("n") % 3 == 0, F.col("used")).alias("tool"), D.has_evidence(F.col("used")).alias("evidence"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Documents as drafts with a phrase put behind every seventh; ids stand for what was asked."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    draft = F.when(i % 7 == 0, F.concat(text, F.lit("信息不足"))).when(i % 5 == 0, F.concat(text, F.lit("第一条、第2条、第三条和第十条"))).otherwise(text)
    return _t(spark, d, "documents").select("doc_id", F.coalesce(D.review_reason(draft, i % 2 == 0, i % 3 == 0, i % 4 == 0, i % 8 == 0), F.lit("none")).alias("reason"))


QUERIES = {"supplied_facts": supplied, "clarifications": clarifications, "fallback_tool": fallback, "draft_reviews": reviews}
SQL = {
    "supplied_facts": TURNS.results("id int, root string, pairs string, meaningful boolean, numbers int", _FACTS),
    "clarifications": CLARIFICATIONS.results("id int, question string", _CLARIFIED),
    "fallback_tool": f"""WITH c AS (SELECT conv_id, list(DISTINCT CASE role WHEN 'system' THEN 'prepare_context' WHEN 'assistant' THEN 'rag_search' ELSE 'none' END) AS used, arg_max(role, turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
 SELECT conv_id, CASE WHEN last <> 'user' AND n % 2 <> 0 AND n % 3 <> 0 THEN NULL WHEN last = 'user' AND NOT list_contains(used, 'rag_search') THEN 'rag_search' WHEN NOT list_contains(used, 'prepare_context') THEN 'prepare_context'
 WHEN NOT list_contains(used, 'rag_search') THEN 'rag_search' ELSE 'retrieve_from_kb' END AS tool, list_has_any(used, {strings(D.EVIDENCE)}) AS evidence FROM c""",
    "draft_reviews": """WITH a AS (SELECT doc_id AS i, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '信息不足' WHEN doc_id % 5 = 0 THEN '第一条、第2条、第三条和第十条' ELSE '' END AS t FROM documents),
 b AS (SELECT i, i % 7 = 0 AS doubt, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) >= 260 AND i % 5 = 0 AND i % 7 <> 0 AS dump FROM a)
 SELECT i AS doc_id, CASE WHEN doubt THEN 'doubt' WHEN i % 2 = 0 AND NOT (i % 8 = 0 AND NOT dump) THEN 'precise' WHEN i % 2 <> 0 AND i % 3 = 0 AND dump THEN 'statutes' ELSE 'none' END AS reason FROM b""",
}
