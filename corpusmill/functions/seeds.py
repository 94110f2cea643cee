"""Seeds of training runs out of instruction rows, as Column expressions: prompts, strategies, tools, retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Subsets and families that give seeds, phrases of a judgement, the mark of a cut, words added to queries.
SUBSETS = ("DISC-Law-SFT-Pair-QA-released", "DISC-Law-SFT-Pair", "DISC-Law-SFT-Triplet-QA-released", "DISC-Law-SFT-Triplet-released")
DIRECT = ("jud_doc_sum", "jud_read_compre", "leg_case_cls", "leg_eve_detec", "op_sum", "sim_case_match")
RETRIEVAL = ("legal_question_answering", "exam", "sent_pred", "judgement_predit")
JUDGEMENT = ("本院认为", "判决如下", "裁定如下", "判决结果", "法院认为", "结论")
CUT = "\n\n[中间内容截断]\n\n"
EXAM_WORDS, SENTENCE_WORDS = "法条 选项 解析", "定罪 量刑 判决"
LOOKUP, RETRIEVE = "lookup_statute", "retrieve_from_kb"


def _strip(text: Column, right_only: bool = False) -> Column:
    return F.regexp_replace(text, r"\s+$" if right_only else r"^\s+|\s+$", "")


def compress_prompt(text: Column, size: int = 2800, marks: tuple[str, ...] = JUDGEMENT) -> Column:
    """A long prompt as its first 1,600 characters and 900 from 280 before the first mark of a judgement on, or its last 900."""
    own = _strip(text)
    found = F.least(*(F.nullif(F.instr(own, F.lit(m)), F.lit(0)) for m in marks), F.lit(None).cast("int")) - 1
    start = F.greatest(found - 280, F.lit(1600))
    tail = F.when(found.isNull(), F.right(own, F.lit(900))).otherwise(F.substring(own, start + 1, F.greatest(found + 900 - start, F.lit(0))))
    return F.when(F.length(own) <= size, own).otherwise(F.concat(_strip(F.substring(own, 1, 1600), right_only=True), F.lit(CUT), _strip(tail)))


def eligible(subset: Column, family: Column, question: Column) -> Column:
    """Rows of a known subset and family whose question has 6 to 3,600 characters."""
    return F.coalesce(subset.isin(*SUBSETS) & family.isin(*DIRECT, *RETRIEVAL) & F.length(question).between(6, 3600), F.lit(False))


def strategy(family: Column, references: Column) -> Column:
    return F.when(family.isin(*DIRECT), "direct_answer").when(F.size(references) > 0, "lookup_then_retrieve").otherwise("retrieve_then_answer")


def expected_tools(strategy_: Column, titles: Column) -> Column:
    lookup = F.when((strategy_ == "lookup_then_retrieve") & (F.size(titles) > 0), LOOKUP)
    return F.array_compact(F.array(lookup, F.when(strategy_ != "direct_answer", RETRIEVE)))


def force_error(strategy_: Column, sample: Column) -> Column:
    """Every tenth sample with a lookup gets an error to recover from."""
    return (strategy_ == "lookup_then_retrieve") & sample.endswith("0")


def compact(text: Column, size: int = 280) -> Column:
    flat = _strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, size - 1), "[ ，,；;：:]+$", ""), F.lit("…")))


def retrieval_query(family: Column, question: Column, titles: Column) -> Column:
    """Null for families answered directly; or the shortened question, the family's words and two titles, each once."""
    words = F.when(family == "exam", EXAM_WORDS).when(family.isin("sent_pred", "judgement_predit"), SENTENCE_WORDS)
    parts = F.concat(F.array(compact(question, 260), words), F.transform(F.slice(titles, 1, 2), lambda t: F.concat(F.lit("《"), t, F.lit("》"))))
    return F.when(~family.isin(*DIRECT), F.array_join(F.filter(F.array_distinct(F.array_compact(parts)), lambda p: p != ""), " "))
