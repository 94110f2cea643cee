"""Candidates of question and case banks out of instruction rows, as Column expressions: questions, options, answers, summaries.

A null text counts as an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .rules import ANSWER_ENDS

#: Marks of a question, phrases around it, what stands before an answer and names its label.
QUESTION_MARKS = ("<问题>：", "<问题>:", "问题：", "问题:")
STEM_HINTS = ("下列", "以下", "哪一", "何种", "正确", "错误", "是否", "请问", "可以", "应当", "如何", "处理", "属于", "说法", "判断", "结果", "选项", "?", "？")
PREFIXES = (
    "请给出以下单选问题的答案和推理过程：",
    "请给出这道单选题的答案和推理过程。",
    "请给出这道单选题的答案和推理过程：",
    "请给出单选题的答案和解析。",
    "请给出单选题的答案和解析：",
    "请给出单选题的答案。",
    "请给出答案和解析。",
    "请给出答案和解析：",
    "以下是一道单项选择题：",
    "以下是一道单选题：",
    "这是一道单选题。",
    "这是一道单选题：",
    "单选：",
    "单项选择题：",
    "问题：",
    "问题:",
)
SUFFIXES = (
    "请给出答案和解析",
    "请给出答案",
    "请给出详细的推理过程之后再给出答案",
    "请给出推理过程",
    "给出详细的推理过程之后再给出答案",
    "请一步步思考，选择合适的选项并给出理由",
    "请一步步思考并给出理由",
    "请一步步思考",
)
ANSWER_PREFIXES = ("正确答案：", "正确答案:", "参考答案：", "参考答案:", "答案：", "答案:")
MARKER = r"(?<![A-Za-z])([A-D])[.．、]\s*"
LABELS = (r"^\s*(?:答案(?:为)?|应选|选择|选|正确的是|正确选项是)?[:：]?\s*([A-D])(?:[.．、\s]|$)", r"选项\s*([A-D])", r"答案(?:为)?\s*([A-D])")
SENTENCE_END, CLAUSE_END = r"(?<=[。！？!?；;])\s*", r"(?<=[，,：:])\s*"
NO_WORD = r"[\s，,。；;：:！!？?（）()《》“”\"'、]+"
#: Families that are cases, what a case asks for, what tells of facts, and the prompts put before bare facts.
CASE_FAMILIES = ("jud_read_compre", "judgement_predit", "sim_case_match", "leg_case_cls", "jud_doc_sum")
ACTIONS = (
    "请阅读以下案情", "请根据以下案情", "请结合以下案情", "请结合案情", "请分析", "请说明理由", "结合法律规定", "推理出以下案件中的判决", "推断案件判决", "判决结果", "裁判结果",
    "如何处理", "如何认定", "如何定性", "是否构成", "是否违法", "应承担", "争议焦点", "法律后果", "应如何", "何罪",
)
FACTS = ("案情", "本案", "被告人", "原告", "被告", "上诉人", "被上诉人", "申请人", "被申请人", "人民检察院指控", "法院经审理查明", "甲公司", "乙公司", "某公司", "某企业", "某厂", "某村", "某县", "某市")
FACT_PATTERN = r"(?:19|20)\d{2}年|甲[乙丙丁]|乙[方人]|丙[方人]|丁[方人]"
ENUMERATION = r"^(?:第?[一二三四五六七八九十百]+[、.．)]|\d+[、.．)])\s*"
CASE_PROMPT = "请阅读以下案情，结合法律规定进行案例分析并作答："
CASE_PROMPTS = {
    "judgement_predit": "请阅读以下案情，推断案件判决结果并说明理由：",
    "jud_doc_sum": "请阅读以下案情，概括案件要点并结合法律规定作答：",
    "leg_case_cls": "请阅读以下案情，判断其所属法律问题并说明理由：",
    "sim_case_match": "请阅读以下案情，分析其法律争点并作答：",
    "jud_read_compre": "请阅读以下案情，结合法律规定进行案例分析并作答：",
}
UNNAMED_CASE = "未命名案例"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is computed once as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _clean(text: Column) -> Column:
    return T.clean_text(F.coalesce(text, F.lit("")))


def _any(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, phrases)) + ")"


def _strip(text: Column, marks: str, left: bool = True) -> Column:
    marks = re.escape(marks)
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$" if left else f"[{marks}]+$", "")


def _after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of the mark."""
    return F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))


def _clipped(text: Column, size: int) -> Column:
    return _strip(F.substring(text, 1, size), " ，,；;：:", left=False)


def _fits(text: Column, size: int) -> Column:
    return (text != "") & (F.length(text) <= size)


def _first(text: Column, marks: tuple[str, ...], part: Callable[[Column, str], Column], otherwise: Column) -> Column:
    """``part`` by the first of the marks, in their order, that the text holds."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(m)), part(text, m)) for m in marks), otherwise)


def sanitize_question(text: Column) -> Column:
    """Without the phrases before and after a question, and punctuation at its ends."""
    own = F.regexp_replace(_clean(text), f"^(?:{_any(PREFIXES)}\\s*)+", "")
    return _strip(_clean(F.regexp_replace(own, _any(SUFFIXES) + ".*", "")), " ：:；;。")


def extract_question(instruction: Column, family: Column) -> Column:
    """A question-answering row asks what follows its last mark of a question."""
    marked = _let(_clean(instruction), lambda t: F.when(family == "legal_question_answering", _first(t, QUESTION_MARKS, lambda x, m: F.trim(F.substring_index(x, m, -1)), t)).otherwise(t))
    return sanitize_question(marked)


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    return F.filter(F.transform(F.split(_clean(text), end), lambda s: F.trim(s)), lambda s: s != "")


def summary(text: Column, size: int, most: int, clauses: bool = True) -> Column:
    """The cleaned text if it fits; or else the first sentences that fit, ``most`` at most, then the first clauses; or empty."""

    def leading(t: Column, end: str) -> Column:
        joined = lambda done, s: F.when(done["text"] == "", s).otherwise(_clean(F.concat(done["text"], F.lit(" "), s)))
        none = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))
        add = lambda done, s: _let(joined(done, s), lambda j: F.when(done["open"] & (F.length(j) <= size), F.struct(j.alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(done["text"].alias("text"), F.lit(False).alias("open"))))
        return F.aggregate(F.slice(sentences(t, end), 1, most), none, add, lambda done: _strip(done["text"], "，,；;：:", left=False))

    def whole(t: Column) -> Column:
        ways = [F.nullif(leading(t, end), F.lit("")) for end in ((SENTENCE_END, CLAUSE_END) if clauses else (SENTENCE_END,))]
        return F.when(F.length(t) <= size, t).otherwise(F.coalesce(*ways, F.lit("")))

    return _let(_clean(text), whole)


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def has_facts(text: Column) -> Column:
    own = _clean(text)
    return T.contains_any(own, FACTS) | F.coalesce(own.rlike(FACT_PATTERN), F.lit(False))


def has_action(text: Column) -> Column:
    return T.contains_any(_clean(text), ACTIONS)


def is_case(question: Column, answer: Column, family: Column) -> Column:
    """Rows of a case family, and texts with facts that ask for an analysis or are long (question 60, answer 180)."""
    long = lambda q: has_action(q) | (F.length(q) >= 60) | (F.length(_clean(answer)) >= 180)
    return F.coalesce(_let(sanitize_question(question), lambda q: (q != "") & (family.isin(*CASE_FAMILIES) | (has_facts(q) & long(q)))), F.lit(False))


def case_question(text: Column, family: Column, size: int = 760) -> Column:
    """A case that asks something, shortened; bare facts get the family's prompt; empty for anything else."""
    prompt = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in CASE_PROMPTS.items() for x in p)), family), F.lit(CASE_PROMPT))
    asked = lambda t: F.when(F.length(t) <= size, t).otherwise(_or(summary(t, size, 5, False), _clipped(t, size)))

    def budgeted(p: Column, facts: Column) -> Column:
        room = {n: max(240, size - n - 1) for n in sorted({len(x) for x in (CASE_PROMPT, *CASE_PROMPTS.values())})}
        short = F.coalesce(*(F.when(F.length(p) == n, _or(summary(facts, most, 5, False), _clipped(facts, most))) for n, most in room.items()))
        return F.concat(p, F.lit("\n"), F.when(F.length(p) + 1 + F.length(facts) <= size, facts).otherwise(short))

    bare = lambda t: _let(_clean(F.regexp_replace(t, ENUMERATION, "")), lambda facts: _let(prompt, lambda p: budgeted(p, facts)))
    return _let(sanitize_question(text), lambda t: F.when(has_action(t), asked(t)).when(has_facts(t), bare(t)).otherwise(""))


def freeform_question(text: Column, size: int = 220) -> Column:
    """A question that fits; what follows a mark of one; a sentence that asks; two sentences; or its start."""

    def short(t: Column) -> Column:
        marked = (_let(_clean(_after(t, m)), lambda c: F.when(_fits(c, size), c)) for m in ("问题：", "问题:", "问：", "问:", "请问"))
        after = F.coalesce(*(F.when(F.contains(t, F.lit(m)), c) for m, c in zip(("问题：", "问题:", "问：", "问:", "请问"), marked)))
        asking = F.get(F.filter(sentences(t), lambda s: (F.length(s) <= size) & T.contains_any(s, STEM_HINTS)), F.lit(0))
        return F.coalesce(after, asking, _or(summary(t, size, 2, False), _clipped(t, size)))

    return _let(sanitize_question(text), lambda t: F.when(F.length(t) <= size, t).otherwise(short(t)))


def choice_stem(text: Column, size: int = 520) -> Column:
    """A stem that fits, or what starts at the last of a mark, marks in order; or empty."""
    marks = ("问题：", "问题:", "请问", "下列", "以下", "关于")
    last = lambda t, m: _let(_clean(F.concat(F.lit(m), F.substring_index(t, m, -1))), lambda c: F.when(F.contains(t, F.lit(m)) & _fits(c, size), c))
    short = lambda t: F.coalesce(*(last(t, m) for m in marks), F.lit(""))
    return _let(sanitize_question(text), lambda t: F.when(F.length(t) <= size, t).otherwise(short(t)))


def is_stem(text: Column) -> Column:
    return T.contains_any(_clean(text), STEM_HINTS)


def _without_label(text: Column) -> Column:
    """Without the first option label."""
    return F.regexp_replace(text, r"(?s)^(.*?)(?<![A-Za-z])[A-D][.．、]\s*(.*)$", "$1$2")


def _without_prefix(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_any(ANSWER_PREFIXES)}\\s*", "")


def _option(text: Column) -> Column:
    own = F.regexp_replace(_without_label(_without_prefix(_clean(text))), _any(SUFFIXES + ANSWER_ENDS) + ".*", "")
    return _strip(_clean(own), " ：:；;，,。")


def choice_parts(question: Column) -> Column:
    """[stem, A, B, C, D] where the first four option labels are these and their texts are different and of 1 to 220 characters; or null."""

    def parts(p: Column) -> Column:
        options = F.transform(F.slice(p, 2, 4), _option)
        return _let(options, lambda o: F.when((F.size(F.array_distinct(o)) == 4) & F.forall(o, lambda x: _fits(x, 220)), F.concat(F.array(F.trim(F.get(p, F.lit(0)))), o)))

    labels = F.slice(F.regexp_extract_all(question, F.lit(MARKER), F.lit(1)), 1, 4)
    return F.when(labels == F.array(*map(F.lit, "ABCD")), _let(F.split(question, MARKER, 5), parts))


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(_clean(text), NO_WORD, ""))


def answer_core(answer: Column) -> Column:
    """The answer without what announces it, its explanation, its label and phrases after it."""
    head = _let(_without_prefix(_clean(answer)), lambda t: _first(t, ANSWER_ENDS, lambda x, m: F.trim(F.substring_index(x, m, 1)), t))
    return _strip(_clean(F.regexp_replace(_without_label(head), _any(SUFFIXES) + ".*", "")), " ：:；;。")


def answer_label(answer: Column, options: Column) -> Column:
    """The label that the answer names; or of the first option whose text equals, starts or is part of it; or null."""
    named = F.coalesce(*(F.nullif(F.regexp_extract(_clean(answer), p, 1), F.lit("")) for p in LABELS))
    position = lambda k: F.get(F.filter(F.sequence(F.lit(1), F.size(options)), lambda i: _let(_key(F.get(options, i - 1)), lambda o: (k != "") & (o != "") & F.contains(k, o))), F.lit(0))
    return F.coalesce(named, _let(_key(answer_core(answer)), lambda k: F.get(F.array(*map(F.lit, "ABCD")), position(k) - 1)))


def answer_summary(answer: Column, size: int = 90) -> Column:
    """The core of the answer, its first sentence or clauses, or what stands before a comma or colon (12 characters or more)."""
    marks = ("，", ",", "：", ":")
    head = lambda t, m: _let(F.trim(F.substring_index(t, m, 1)), lambda c: F.when(F.contains(t, F.lit(m)) & F.length(c).between(12, size), c))
    before = lambda t: F.coalesce(*(head(t, m) for m in marks), F.lit(""))
    return _let(answer_core(answer), lambda t: F.when(F.length(t) <= size, t).otherwise(_or(summary(t, size, 1), before(t))))


def reference_answer(answer: Column, size: int = 680) -> Column:
    return _or(summary(answer, size, 4, False), F.when(_clean(answer) == "", "").otherwise(T.truncate_text(answer, size)))


def analysis(answer: Column, correct: Column, size: int = 480) -> Column:
    """The explanation in an answer without an echo of the right one, three sentences at most; or the right answer."""
    tail = lambda x, m: _or(F.trim(_after(x, m)), F.trim(F.substring_index(x, m, 1)))
    explained = _let(_without_label(_without_prefix(_clean(answer))), lambda t: _first(t, ANSWER_ENDS, tail, t))
    right = _clean(F.coalesce(correct, F.lit("")))

    def unechoed(t: Column, c: Column) -> Column:
        rest = F.regexp_replace(F.substring(t, F.length(c) + 1, F.length(t)), "^[ ，,；;：:。]+", "")
        return F.when((c != "") & t.startswith(c) & (rest != ""), _clean(rest)).otherwise(t)

    def chosen(t: Column, c: Column) -> Column:
        return _or(summary(t, size, 3, False), F.when(F.length(t) <= 1200, t).when(F.length(c) <= size, c).otherwise(F.lit("")))

    return _let(right, lambda c: _let(_or(unechoed(_clean(explained), c), c), lambda t: chosen(t, c)))


def case_title(topic: Column, question: Column, size: int = 36) -> Column:
    """The topic and the question without question marks: whole, its first sentence, up to a mark, or its start."""
    marks = ("。", "，", ",", "：", ":")
    head = lambda t, m: _let(_clean(F.substring_index(t, m, 1)), lambda c: F.when(F.contains(t, F.lit(m)) & _fits(c, size), c))
    before = lambda t: F.coalesce(*(head(t, m) for m in marks))
    long = lambda t: F.coalesce(F.nullif(summary(t, size, 1, False), F.lit("")), before(t), _strip(F.substring(t, 1, size), "，,；;：:", left=False))
    base = _let(F.trim(F.regexp_replace(_clean(question), "[？?]", "")), lambda t: F.when(t == "", UNNAMED_CASE).when(F.length(t) <= size, t).otherwise(long(t)))
    return F.concat(topic, F.lit("案例："), base)


def case_facts(question: Column) -> Column:
    return _or(summary(question, 900, 3, False), _clean(question))


def case_issue(question: Column) -> Column:
    return _or(summary(question, 220, 1, False), _clean(question))


def case_holding(analysis_: Column, answer: Column) -> Column:
    text = _or(analysis_, answer)
    return _or(summary(text, 1200, 4, False), _clean(text))
