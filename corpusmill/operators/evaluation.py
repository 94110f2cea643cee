"""Evaluation of answers and tool use as Column expressions, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the metrics, thresholds of a completed task and of the rule-based judge.
WEIGHTS = {"answer_quality": 0.40, "citation_hit_rate": 0.15, "tool_use_accuracy": 0.15, "format_compliance": 0.10, "task_completion": 0.10, "error_recovery": 0.10}
COMPLETE_QUALITY, COMPLETE_SEMANTIC = 0.68, 0.82
JUDGE_F1, JUDGE_F1_CITED = 0.55, 0.35


def format_compliance(trace: Column) -> Column:
    """A trace needs a final answer, and an observation for each action."""
    actions, seen = F.regexp_count(trace, F.lit("(?m)^Action:")), F.regexp_count(trace, F.lit("(?m)^Observation:"))
    return F.when(~F.contains(trace, F.lit("Final Answer:")), 0.0).when((actions == 0) | (seen >= actions), 1.0).otherwise(0.0)


def citation_hit_rate(answer: Column, references: Column) -> Column:
    """Share of references whose title between title marks is in the answer; null without references. References without marks count as missed."""
    title = lambda r: F.regexp_extract(r, "《[^》]*》", 0)
    hits = F.size(F.filter(references, lambda r: (title(r) != "") & F.contains(answer, title(r))))
    return F.when(F.size(references) > 0, hits.cast("double") / F.size(references))


def error_recovery(trace: Column, forced: Column) -> Column:
    """Whether an action and a final answer come after the last error; null where no error was forced."""
    tail = F.regexp_extract(trace, r"(?is)^.*((?:error|失败).*)$", 1)
    return F.when(forced, F.when(F.contains(tail, F.lit("Action:")) & F.contains(tail, F.lit("Final Answer:")), 1.0).otherwise(0.0))


def tool_use_accuracy(used: Column, expected: Column) -> Column:
    """0.6 times the share of expected tools used at their place, and 0.4 times F1 of both bags."""
    at_place = F.size(F.filter(F.arrays_zip(used.alias("u"), expected.alias("e")), lambda p: p["u"] == p["e"]))
    return F.when(F.size(expected) == 0, F.when(F.size(used) == 0, 1.0).otherwise(0.0)).otherwise(0.6 * at_place / F.size(expected) + 0.4 * T.token_f1(used, expected))


def answer_quality(exact: Column, f1: Column, semantic: Column) -> Column:
    return 0.25 * exact + 0.35 * f1 + 0.40 * semantic


def task_completion(quality: Column, semantic: Column, citation: Column) -> Column:
    done = (quality >= COMPLETE_QUALITY) | ((semantic >= COMPLETE_SEMANTIC) & (F.coalesce(citation, F.lit(0.0)) > 0))
    return F.when(done, 1.0).otherwise(0.0)


def judge(exact: Column, f1: Column, citation: Column) -> Column:
    return (exact > 0) | (f1 >= JUDGE_F1) | ((f1 >= JUDGE_F1_CITED) & (F.coalesce(citation, F.lit(0.0)) > 0))


def overall(weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the metrics that are not null."""
    top = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items())
    low = sum(F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items())
    return F.when(low > 0, top / low).otherwise(0.0)


def improvement() -> Column:
    """By how much the adapted row (prefix a_) is better than the base row (prefix b_)."""
    delta = lambda c: F.coalesce(F.col("a_" + c), F.lit(0.0)) - F.coalesce(F.col("b_" + c), F.lit(0.0))
    return 1.5 * delta("overall") + 1.0 * delta("completion") + 0.5 * delta("quality") + 0.25 * delta("tool")


def diverse(rows: DataFrame, family: str, n: int, *order: Column) -> DataFrame:
    """The first n rows: the best of each family in order, then the rest in order. Families have at most n candidates each, cut before the sort."""
    own = rows.withColumn("in_family", F.row_number().over(Window.partitionBy(family).orderBy(*order))).filter(F.col("in_family") <= n)
    return own.orderBy((F.col("in_family") > 1).cast("int"), *order).limit(n)


def sigmoid(x: Column) -> Column:
    return F.when(x > 15, 0.99).when(x < -15, 0.01).otherwise(1 / (1 + F.exp(-x)))
