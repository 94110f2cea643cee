"""An agent's view of questions, clarifications and drafts, as Column expressions. A null text counts as an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Words left out of keywords, marks of doubt, clarifications, exact results, computations and places.
STOPWORDS = (
    "怎么", "如何", "一下", "这个", "那个", "什么", "哪些", "还有", "然后", "就是", "已经", "现在", "刚刚", "好像", "不知道", "是否", "可以", "需要", "应该", "一下子", "请问",
    "帮我", "一下吧", "情况", "问题", "补充", "事实", "原始", "法律", "继续", "分析", "这家", "大概", "具体", "精确",
)
DOUBT = ("无法精确", "无法确定", "不能确定", "难以确定", "难以判断", "无法直接判断", "仍需确认", "需进一步确认", "仍需补充", "信息不足", "证据不足")
CLARIFIES = ("请", "补充", "说明", "确认", "是否", "有无", "何时", "多少", "哪", "谁", "责任", "比例", "标准", "税率", "税种", "税则", "完税价格", "汇率", "金额", "数额")
PRECISE = ("精确", "多少", "几", "几年", "金额", "税额", "罚款", "赔偿", "补交", "具体怎么算", "具体计算", "准确", "具体数额")
COMPUTES = ("算", "计算", "税额", "罚款", "赔偿", "补偿", "利息", "金额", "数额", "补交", "多少税")
PLACE = ("所在地", "居住地", "住址", "地址", "地点", "省", "市", "区县", "区", "县", "街道", "乡镇", "位置")
WHERE = ("所在地", "居住地", "省、市", "区县", "街道", "乡镇", "哪个省", "哪个市", "行政区")
ROOT, SUPPLIED = "原始法律问题：", "已补充事实："
NUMBER, ARTICLE = r"(\d+(?:\.\d+)?[%％]?)", "(第[一二三四五六七八九十百千万\\d]+条)"
DEFAULT_CLARIFICATION = "请补充当前最影响结论的一项关键信息。"
ENDS, OPENINGS = "[。？?！!]$", "^(?:请|是否|有无|能否|哪一|哪种|何时|多少|几)"
FOLLOWUP_ROLES = ("supplement", "answer_to_followup", "correction")
EVIDENCE = ("rag_search", "retrieve_from_kb", "lookup_statute", "calculator")
TOOLS = ("prepare_context", "rag_search", "retrieve_from_kb")
REVIEWS = ("doubt", "precise", "statutes")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def is_clarification(text: Column) -> Column:
    """A text of at most 120 characters that asks for something."""
    return (F.length(_bare(text)) <= 120) & T.contains_any(_bare(text), CLARIFIES)


def supplied_facts(question: Column) -> Column:
    """(prompt, answer) of each line after the mark of supplied facts; the prompt is empty where a line names none."""

    def pair(line: Column) -> Column:
        def by(mark: str, otherwise: Column) -> Column:
            prompt, answer = _strip(F.substring_index(line, mark, 1)), _strip(F.substring(line, F.instr(line, F.lit(mark)) + 1, F.length(line)))
            named = F.contains(line, F.lit(mark)) & (prompt != "") & (answer != "") & is_clarification(prompt)
            return F.when(named, F.struct(prompt.alias("prompt"), answer.alias("answer"))).otherwise(otherwise)

        return by("：", by(":", F.struct(F.lit("").alias("prompt"), line.alias("answer"))))

    own = F.coalesce(question, F.lit(""))
    block = F.substring(own, F.instr(own, F.lit(SUPPLIED)) + len(SUPPLIED), F.length(own))
    lines = F.filter(F.transform(F.split(block, r"\r\n|[\n\r]"), lambda x: _strip(F.regexp_replace(_strip(x), "^[- ]+", ""))), lambda x: x != "")
    return F.when(F.contains(own, F.lit(SUPPLIED)), F.transform(lines, pair)).otherwise(F.filter(F.array(F.struct(F.lit("").alias("prompt"), F.lit("").alias("answer"))), lambda x: F.lit(False)))


def root_question(question: Column) -> Column:
    """What a composed question says of the first one, or itself."""
    return F.coalesce(F.nullif(_strip(F.regexp_extract(_strip(question), ROOT + r"([^\n]+)", 1)), F.lit("")), _strip(question))


def facts(question: Column) -> Column:
    return F.array_join(F.transform(supplied_facts(question), lambda p: p["answer"]), " ")


def significant(text: Column) -> Column:
    """Tokens that are no stop word, letter or single digit, repeats included."""
    return F.filter(T.tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))


def keywords(question: Column, most: int = 10) -> Column:
    numbers = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(NUMBER), F.lit(1))
    return F.slice(F.array_distinct(F.concat(significant(question), numbers)), 1, most)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the significant tokens."""
    a, b = F.array_distinct(significant(a)), F.array_distinct(significant(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def wants_precise(question: Column) -> Column:
    return T.contains_any(_bare(question), PRECISE)


def wants_computation(question: Column) -> Column:
    return T.contains_any(_bare(question), COMPUTES)


def number_count(question: Column) -> Column:
    """Numbers in the supplied facts, or in the question where there are none."""
    return F.regexp_count(F.coalesce(F.nullif(facts(question), F.lit("")), question, F.lit("")), F.lit(NUMBER))


def asks_place(question: Column) -> Column:
    return T.contains_any(_bare(question), PLACE)


def asked_where(questions: Column) -> Column:
    """Whether one of the clarifications asks for a place."""
    return F.exists(questions, lambda q: T.contains_any(q, WHERE))


def embedded_question(text: Column) -> Column:
    """The question inside a JSON object or an assignment; or the text without field names."""
    own = F.regexp_replace(_strip(text), r"^[{}]+|[{}]+$", "")
    json = F.nullif(_strip(F.get_json_object(_strip(text), "$.question")), F.lit(""))
    quoted = (F.nullif(_strip(F.regexp_extract(own, rf"(?i)question\s*[:：=]\s*{a}([^{b}]+){b}", 1)), F.lit("")) for a, b in (('"', '"'), ("'", "'"), ("“", "”")))

    def plain(t: Column) -> Column:
        named = F.regexp_replace(F.regexp_replace(t, r"(?i)^question\s*[:：=]\s*", ""), "^[\\s\"'“”]+|[\\s\"'“”]+$", "")
        return _strip(F.when(F.lower(t).startswith("question"), named).otherwise(t))

    cut = F.when(own.rlike("(?s)[,， ] ?field_name"), F.regexp_replace(_strip(F.regexp_replace(own, "(?s)(?:, |，| )field_name.*", "")), "[,，;；]+$", "")).otherwise(own)
    return F.coalesce(json, *quoted, _let(cut, plain))


def clarification(question: Column) -> Column:
    """A clarification with a mark at its end; the default one for an empty text."""
    lines = F.array_join(F.filter(F.transform(F.split(F.coalesce(question, F.lit("")), r"\r\n|[\n\r]"), _strip), lambda x: x != ""), "\n")
    named = lambda t: _let(embedded_question(t), lambda e: F.when(e != "", e).otherwise(t))
    closed = lambda t: F.when(t == "", DEFAULT_CLARIFICATION).when(t.rlike(ENDS), t).when(t.rlike(OPENINGS), F.concat(t, F.lit("？"))).otherwise(F.concat(t, F.lit("。")))
    return _let(lines, lambda t: _let(named(t), closed))


def statute_dump(answer: Column) -> Column:
    """A long answer (260 characters) that names four articles or more."""
    return (F.length(_strip(answer)) >= 260) & (F.regexp_count(_strip(answer), F.lit(ARTICLE)) >= 4)


def _tells(text: Column) -> Column:
    return text.rlike(r"\d") | (F.size(significant(text)) >= 3)


def meaningful_answer(role: Column, question: Column) -> Column:
    """A turn that answers a clarification and brings facts, a number or three significant tokens."""
    own, supplied = _strip(question), facts(question)
    return F.coalesce(role.isin(*FOLLOWUP_ROLES), F.lit(False)) & (own != "") & (((supplied != "") & _tells(supplied)) | _tells(own))


def has_evidence(tools: Column) -> Column:
    return F.arrays_overlap(tools, F.array(*map(F.lit, EVIDENCE)))


def review_reason(answer: Column, precise: Column, brief: Column, clarified: Column, meaningful: Column) -> Column:
    """Why a draft is looked at again, one of REVIEWS; or null. An exact result asked for passes after a clarification with a meaningful answer, unless the draft lists statutes."""
    own = F.coalesce(answer, F.lit(""))
    passed = clarified & meaningful & ~statute_dump(own)
    return F.when(T.contains_any(own, DOUBT), REVIEWS[0]).when(precise & ~passed, REVIEWS[1]).when(~precise & brief & statute_dump(own), REVIEWS[2])


def fallback_tool(step: Column, intent: Column, answered: Column, used: Column) -> Column:
    """The tool to go on with: the one recommended, or the first in TOOLS; retrieval may be repeated, the others not. Null where none is called for."""
    wanted = F.coalesce(step.isin(*TOOLS), F.lit(False))
    called = wanted | F.coalesce(intent == "legal_qa", F.lit(False)) | answered
    order = F.array_distinct(F.array_compact(F.concat(F.array(F.when(wanted, step)), F.array(*map(F.lit, TOOLS)))))
    return F.when(called, F.get(F.filter(order, lambda t: (t == TOOLS[2]) | ~F.array_contains(used, t)), F.lit(0)))


def compact_question(text: Column, size: int = 220) -> Column:
    """A short text of few lines as it is; or its first lines, six at most, as far as they fit; or its start."""
    own = _strip(text)

    def leading(t: Column) -> Column:
        lines = F.slice(F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), _strip), lambda x: x != ""), 1, 6)
        joined = lambda done, s: F.when(done["text"] == "", s).otherwise(F.concat(done["text"], F.lit(" "), s))
        add = lambda done, s: F.when(done["open"] & (F.length(joined(done, s)) <= size), F.struct(joined(done, s).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(done["text"].alias("text"), F.lit(False).alias("open")))
        first = F.aggregate(lines, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), add, lambda done: done["text"])
        return F.regexp_replace(F.substring(F.coalesce(F.nullif(first, F.lit("")), F.substring(t, 1, size)), 1, size), "[ ，,;；]+$", "")

    short = (F.length(own) <= size) & (F.regexp_count(own, F.lit("\n")) <= 4)
    return F.when(short, own).otherwise(_let(own, leading))


def search_query(question: Column) -> Column:
    """The compact first question, the facts and keywords of both, each once."""
    root, known = root_question(question), facts(question)
    both = F.concat_ws(" ", F.nullif(F.substring(root, 1, 1200), F.lit("")), F.nullif(known, F.lit("")))
    parts = F.transform(F.concat(F.array(compact_question(root), known), keywords(both)), _strip)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")
