"""Bank-building queries: candidates and seeds out of instruction rows, balanced draws, lookups by id and title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import seeds as S
from ..functions import text as T
from ..operators import lookup as L
from ._inline import Every, Inline


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


ROWS = Every(
    "id int, family string, instruction string, answer string",
    [
        (1, "exam", "以下是一道单选题： 下列说法正确的是？A.甲 B.乙、 C．丙。 D、丁 请给出答案和解析。", "答案：B 解析：甲错误。"),
        (2, "exam", "问题：哪一说法正确？A.租赁 B.买卖 C.借款 D.保管", "正确答案：C.借款。解析：借款。合同约定利息。"),
        (3, "exam", "下列正确的是 A.一 B.一 C.二 D.三", "选项 A"),
        (4, "exam", "下列正确的是 B.一 A.二 C.三 D.四", "A"),
        (5, "legal_question_answering", "背景。问题：旧的 问题：押金能退吗？", "参考答案：可以退还。理由：合同到期。"),
        (6, "jud_read_compre", "一、被告人盗窃手机一部。", "构成盗窃罪。"),
        (7, "sent_pred", "", ""),
        (8, "exam", "以下哪一属于保管？A.租赁 B.买卖 C.借款 D.保管", "本题考查保管"),
        (9, "exam", None, None),
    ], ids=('id',))
#: By hand: type, question, label, options, answer summary, analysis.
_READ = [
    (1, "choice", "下列说法正确的是？", "B", ["甲", "乙、", "丙", "丁"], "B", "甲错误。"),
    (2, "choice", "哪一说法正确？", "C", ["租赁", "买卖", "借款", "保管"], "借款", "合同约定利息。"),
    (3, "open", "下列正确的是 A.一 B.一 C.二 D.三", None, None, "选项 A", "选项 A"),
    (4, "open", "下列正确的是 B.一 A.二 C.三 D.四", None, None, "A", "A"),
    (5, "open", "押金能退吗？", None, None, "可以退还", "合同到期。"),
    (6, "case", "请阅读以下案情，结合法律规定进行案例分析并作答：\n被告人盗窃手机一部", None, None, "构成盗窃罪", "构成盗窃罪。"),
    (7, "open", "", None, None, "", ""),
    (8, "choice", "以下哪一属于保管？", "D", ["租赁", "买卖", "借款", "保管"], "本题考查保管", "本题考查保管"),
    (9, "open", "", None, None, "", ""),
]


def candidate_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question, options and answer of instruction rows. A row is a choice where its options, stem and answer's label can be read."""
    own = ROWS.df(spark, d).withColumn("text", C.extract_question(F.col("instruction"), F.col("family"))).withColumn("parts", C.choice_parts(F.col("text")))
    options, stem = F.slice("parts", 2, 4), F.get("parts", F.lit(0))
    own = own.withColumn("label", F.when(F.col("parts").isNotNull() & C.is_stem(stem), C.answer_label(F.col("answer"), options)))
    choice = F.col("label").isNotNull()
    kind = F.when(choice, "choice").when(C.is_case(F.col("text"), F.col("answer"), F.col("family")), "case").otherwise("open")
    own = own.withColumn("kind", kind).withColumn("summary", C.answer_summary(F.col("answer")))
    question = F.when(choice, C.choice_stem(stem)).when(F.col("kind") == "case", C.case_question(F.col("text"), F.col("family"))).otherwise(C.freeform_question(F.col("text")))
    right = F.when(choice, F.get(options, F.ascii("label") - 65)).otherwise(F.col("summary"))
    return own.select("id", "kind", question.alias("question"), "label", F.when(choice, options).alias("options"), "summary", C.analysis(F.col("answer"), right).alias("analysis"))


#: The prose of the tables has no judgements: these words stand for their phrases.
MARKS = ("license", "the", "und", "que")
_FAMILY = {"en": "legal_question_answering", "de": "exam", "fr": "sent_pred"}


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    family = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in _FAMILY.items() for x in p)), F.coalesce("lang", F.lit(""))), F.lit("jud_doc_sum"))
    references = F.when(F.col("doc_id") % 3 == 0, F.array(F.coalesce("source", F.lit("none")))).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "documents").select("doc_id", family.alias("family"), references.alias("refs"), F.coalesce("text", F.lit("")).alias("text"))


def seed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Strategy, tools and retrieval query of each document as a question; sources stand for the titles referred to, of every third document."""
    way = S.strategy(F.col("family"), F.col("refs"))
    return _seeded(spark, d).select("doc_id", way.alias("strategy"), F.array_join(S.expected_tools(way, F.col("refs")), "|").alias("tools"), S.force_error(way, F.col("doc_id").cast("string")).alias("force_error"), S.retrieval_query(F.col("family"), F.col("text"), F.col("refs")).alias("query"))


def prompt_compress(spark: SparkSession, d: str) -> DataFrame:
    short = S.compress_prompt(F.col("text"), marks=MARKS)
    return _seeded(spark, d).select("doc_id", F.length(short).alias("n"), F.md5(short.cast("binary")).alias("digest"))


DRAWN = 150


def seed_draw(spark: SparkSession, d: str) -> DataFrame:
    """A balanced draw over sources and languages, documents of a bucket in the order of their digests."""
    bucket = F.concat_ws("::", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    own = _t(spark, d, "documents").select("doc_id", bucket.alias("bucket"))
    return L.balanced_draw(own, "bucket", [F.desc(F.md5(F.col("doc_id").cast("string").cast("binary"))), F.desc("doc_id")], DRAWN).select("doc_id", "bucket", "draw")


WANTED = ("order-1", "part-7", "bench-3", "old-12", "x-customer", "nothing", "order-1")


def record_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Orders, parts and benchmark items as three banks."""
    bank = lambda table, name, key: _t(spark, d, table).select(F.concat(F.lit(name + "-"), F.col(key).cast("string")).alias("record_id"))
    return L.records_by_id([bank("orders", "order", "o_orderkey"), bank("part", "part", "p_partkey"), bank("benchmark", "bench", "item_id")], list(WANTED))


TITLES = Inline("title string", [("中华人民共和国民法典",), ("刑法",), ("公司法_20231229",), ("中华人民共和国刑法",), ("无文",)])
ASKED = Inline("title string", [("《民法典》",), ("刑法",), ("公司法",), ("票据法",), ("无文",), ("刑法",)])
CHUNKS = Inline(
    "title string, position int, heading string, text string",
    [("中华人民共和国民法典", 4, "第四条", "丁"), ("中华人民共和国民法典", 2, "第二条", "乙"), ("中华人民共和国民法典", 1, "第一条", "甲" * 400), ("中华人民共和国民法典", 3, None, "丙"), ("刑法", 1, "第一条", "刑"), ("公司法_20231229", 9, "第九条", "股东"), ("票据法", 1, "第一条", "票")],
)


def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = L.documents_by_title(TITLES.df(spark), CHUNKS.df(spark), ASKED.df(spark))
    return found.select("wanted", "title", F.array_join("headings", "|").alias("headings"), F.array_join("texts", "|").alias("texts"))


QUERIES = {"candidate_questions": candidate_questions, "seed_rules": seed_rules, "prompt_compress": prompt_compress, "seed_draw": seed_draw, "record_by_id": record_by_id, "title_lookup": title_lookup}

_SEEDED = f"""s AS (SELECT doc_id, CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FAMILY.items())} ELSE 'jud_doc_sum' END AS family,
 CASE WHEN doc_id % 3 = 0 THEN coalesce(source, 'none') END AS ref, coalesce(text, '') AS text FROM documents)"""
_FLAT = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_NONE = "list_value()::VARCHAR[]"
_BUCKETED = "o AS (SELECT doc_id, concat(coalesce(source, 'none'), '::', coalesce(lang, 'none')) AS bucket FROM documents)"
SQL = {
    "candidate_questions": ROWS.results("id int, kind string, question string, label string, options array<string>, summary string, analysis string", _READ),
    "seed_rules": f"""WITH {_SEEDED}, w AS (SELECT *, CASE WHEN family = 'jud_doc_sum' THEN 'direct_answer' WHEN ref IS NOT NULL THEN 'lookup_then_retrieve' ELSE 'retrieve_then_answer' END AS strategy, {_FLAT} AS flat FROM s),
 q AS (SELECT *, CASE WHEN length(flat) <= 260 THEN flat ELSE regexp_replace(left(flat, 259), '[ ，,；;：:]+$', '') || '…' END AS head FROM w)
 SELECT doc_id, strategy, CASE strategy WHEN 'direct_answer' THEN '' WHEN 'lookup_then_retrieve' THEN 'lookup_statute|retrieve_from_kb' ELSE 'retrieve_from_kb' END AS tools,
 strategy = 'lookup_then_retrieve' AND doc_id % 10 = 0 AS force_error,
 CASE WHEN strategy <> 'direct_answer' THEN concat_ws(' ', nullif(head, ''), CASE family WHEN 'exam' THEN '{S.EXAM_WORDS}' WHEN 'sent_pred' THEN '{S.SENTENCE_WORDS}' END, '《' || ref || '》') END AS query FROM q""",
    "prompt_compress": rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
 f AS (SELECT *, least({", ".join(f"nullif(instr(t, '{m}'), 0)" for m in MARKS)}) - 1 AS found FROM t), g AS (SELECT *, greatest(found - 280, 1600) AS start FROM f),
 c AS (SELECT doc_id, CASE WHEN length(t) <= 2800 THEN t ELSE regexp_replace(left(t, 1600), '\s+$', '') || '{S.CUT}' || regexp_replace(CASE WHEN found IS NULL THEN right(t, 900) WHEN found + 900 > start THEN substring(t, start + 1, found + 900 - start) ELSE '' END, '^\s+|\s+$', '', 'g') END AS x FROM g)
 SELECT doc_id, length(x) AS n, md5(x) AS digest FROM c""",
    "seed_draw": f"""WITH RECURSIVE {_BUCKETED}, b AS (SELECT bucket, count(*) AS n FROM o GROUP BY bucket),
 d AS (SELECT 0 AS step, list(bucket ORDER BY bucket) AS names, list(n ORDER BY bucket) AS rest, 0 AS turn, NULL::VARCHAR AS drawn FROM b
  UNION ALL SELECT step + 1, CASE WHEN rest[i] = 1 THEN list_concat(names[1:i - 1], names[i + 1:]) ELSE names END,
   CASE WHEN rest[i] = 1 THEN list_concat(rest[1:i - 1], rest[i + 1:]) ELSE list_transform(rest, lambda x, k: CASE WHEN k = i THEN x - 1 ELSE x END) END,
   CASE WHEN rest[i] = 1 THEN turn % greatest(len(names) - 1, 1) ELSE turn + 1 END, names[i]
  FROM (SELECT *, (turn % len(names)) + 1 AS i FROM d WHERE step < {DRAWN} AND len(names) > 0)),
 q AS (SELECT drawn AS bucket, count(*) AS quota FROM d WHERE drawn IS NOT NULL GROUP BY drawn)
 SELECT doc_id, bucket, draw FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR) DESC, doc_id DESC) AS draw FROM o) JOIN q USING (bucket) WHERE draw <= quota""",
    "record_by_id": f"""WITH r AS (SELECT 0 AS bank, 'order-' || o_orderkey AS record_id FROM orders UNION ALL SELECT 1, 'part-' || p_partkey FROM part UNION ALL SELECT 2, 'bench-' || item_id FROM benchmark),
 w AS (SELECT DISTINCT unnest([{", ".join(f"'{x}'" for x in WANTED)}]) AS wanted)
 SELECT wanted, bank, record_id FROM w JOIN r ON contains(record_id, string_split(wanted, '-')[-1]) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY record_id <> wanted, bank, record_id) = 1""",
    "title_lookup": f"""WITH n AS (SELECT title, regexp_replace(title, '_[0-9]{{8}}$', '') AS plain FROM {TITLES.sql}),
 a AS (SELECT alias, max(title) AS title FROM (SELECT plain AS alias, title FROM n UNION SELECT replace(plain, '中华人民共和国', ''), title FROM n) GROUP BY alias),
 w AS (SELECT DISTINCT q.title AS wanted, a.title FROM {ASKED.sql} q JOIN a ON a.alias = replace(replace(q.title, '《', ''), '》', '')),
 c AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY position) AS k FROM {CHUNKS.sql}),
 p AS (SELECT title, string_agg(coalesce(heading, ''), '|' ORDER BY k) AS headings, string_agg(CASE WHEN length(text) <= 320 THEN text ELSE left(text, 319) || '…' END, '|' ORDER BY k) AS texts FROM c WHERE k <= 3 GROUP BY title)
 SELECT wanted, w.title, coalesce(headings, '') AS headings, coalesce(texts, '') AS texts FROM w LEFT JOIN p ON p.title = w.title""",
}
