"""Instruction rows for fine-tuning: one JSON Lines file for each subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from .jsonl import read_jsonl

ROW = "id string, input string, output string, reference string"


def instruction_rows(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, task_family, subset_name (the file's name without its ending), instruction, answer, references.

    ``reference`` may be a text or a list of texts; null and empty ones are no references. Missing texts are empty.
    """
    raw = F.col("reference")
    listed = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.when(raw != "", F.array(raw)), F.array().cast("array<string>"))
    rows = read_jsonl(spark, path, ROW).withColumn("file", F.col("_metadata.file_name"))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    return rows.select(F.col("id").alias("sample_id"), R.task_family(F.col("id")).alias("task_family"), F.regexp_replace("file", r"\.jsonl$", "").alias("subset_name"), text("input").alias("instruction"), text("output").alias("answer"), listed.alias("references"))
