"""Loaders of the question, case and common-knowledge banks into knowledge records.

Fields have aliases; a null or empty value passes to the next alias, and at last to
the default. Strings are trimmed. All work is in expressions over one JSON scan.
A file that does not exist is an empty bank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import read_jsonl_or_empty

#: What a record gets where a field is missing.
TOPIC = "综合"
QUESTION_TITLE = "未命名题目"
CASE_TITLE = "未命名案例"
COMMON_TITLE = "常识条目"
DIFFICULTY = "medium"
SCORE = 20
SOURCE = "local_demo"

QUESTION = (
    "question_id string, id string, record_id string, title string, stem string, question string, options map<string,string>, answer string, "
    "reference_answer string, analysis string, tags array<string>, topic string, question_type string, difficulty string, evaluation_mode string, "
    "references array<string>, source_metadata map<string,string>, score int"
)
CASE = "case_id string, id string, title string, case_title string, facts string, summary string, issue string, holding string, analysis string, statutes array<string>, tags array<string>"
COMMON = "entry_id string, id string, title string, name string, content string, text string, tags array<string>, source string"


def _first(*names: str, default: str = "") -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(default))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """record_id, source_type, title, content, tags, difficulty, metadata; a question with options is a single choice unless it says otherwise."""
    rows = read_jsonl_or_empty(spark, path, QUESTION)
    options = F.coalesce(F.col("options"), F.create_map().cast("map<string,string>"))
    listed = F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), " ")
    topic, reference, analysis = _first("topic", default=TOPIC), F.trim(_first("reference_answer")), F.trim(_first("analysis"))
    kind = _or(F.trim(F.coalesce(F.nullif("question_type", F.lit("")), F.when(F.size(options) > 0, "single_choice").otherwise("short_answer"))), "short_answer")
    mode = F.coalesce(F.nullif("evaluation_mode", F.lit("")), F.when(kind == "single_choice", "objective_choice").otherwise("llm_subjective"))
    return rows.select(
        _first("question_id", "id", "record_id").alias("record_id"),
        F.lit("question_bank").alias("source_type"),
        _or(F.trim(_first("title", "stem", "question")), QUESTION_TITLE).alias("title"),
        _lines(F.trim(_first("stem", "question", "title")), listed, reference, analysis).alias("content"),
        F.array_distinct(F.concat(F.array(topic), _list("tags"))).alias("tags"),
        _first("difficulty", default=DIFFICULTY).alias("difficulty"),
        F.struct(
            "answer", reference.alias("reference_answer"), analysis.alias("analysis"), options.alias("options"), topic.alias("topic"), kind.alias("question_type"), mode.alias("evaluation_mode"),
            _list("references").alias("references"), F.coalesce("source_metadata", F.create_map().cast("map<string,string>")).alias("source_metadata"), F.coalesce("score", F.lit(SCORE)).alias("score"),
        ).alias("metadata"),
    )


def case_bank(spark: SparkSession, path: str) -> DataFrame:
    """record_id, source_type, title, content (facts, issue and holding), tags with the statutes, metadata."""
    title, issue, holding = F.trim(_first("title", "case_title", default=CASE_TITLE)), F.trim(_first("issue")), F.trim(_first("holding", "analysis"))
    return read_jsonl_or_empty(spark, path, CASE).select(
        F.coalesce(F.nullif("case_id", F.lit("")), F.nullif("id", F.lit("")), title).alias("record_id"),
        F.lit("case_bank").alias("source_type"),
        title.alias("title"),
        _lines(F.trim(_first("facts", "summary")), issue, holding).alias("content"),
        F.array_distinct(F.concat(_list("tags"), _list("statutes"))).alias("tags"),
        F.struct(issue.alias("issue"), holding.alias("holding"), _list("statutes").alias("statutes")).alias("metadata"),
    )


def common_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """record_id, source_type, title, content, tags, metadata."""
    title = F.trim(_first("title", "name", default=COMMON_TITLE))
    return read_jsonl_or_empty(spark, path, COMMON).select(
        F.coalesce(F.nullif("entry_id", F.lit("")), F.nullif("id", F.lit("")), title).alias("record_id"),
        F.lit("common_knowledge").alias("source_type"),
        title.alias("title"),
        F.trim(_first("content", "text")).alias("content"),
        _list("tags").alias("tags"),
        F.struct(F.coalesce("source", F.lit(SOURCE)).alias("source")).alias("metadata"),
    )
