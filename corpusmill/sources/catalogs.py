"""Catalogues of documents as CSV files with a heading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The columns a catalogue must have (title, promulgated, in force since, category), and texts that are no date.
COLUMNS = ("标题", "公布日期", "施行日期", "法律法规分类")
NO_DATE = ("", "nan", "none", "nat")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts by their trimmed names; a byte order mark before the first name is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.removeprefix("﻿").strip() for c in rows.columns))


def _date(name: str) -> Column:
    own = F.trim(F.col(name))
    return F.when(~F.lower(own).isin(*NO_DATE), F.substring(own, 1, 10))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The four columns trimmed, dates as their first ten characters, ``source_catalog`` and ``normalized_title``; rows without a title are dropped."""
    rows = read_csv(spark, path)
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    title, promulgated, since, category = COLUMNS
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    own = rows.select(text(title), _date(promulgated).alias(promulgated), _date(since).alias(since), text(category), F.col("_metadata.file_name").alias("source_catalog"))
    return own.filter(F.col(title) != "").withColumn("normalized_title", T.normalize_title(F.col(title)))


def master_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Catalogues in the order given, of equal rows that of the first catalogue."""
    parts = [read_catalog(spark, p).withColumn("position", F.lit(i)) for i, p in enumerate(paths)]
    own = reduce(DataFrame.unionByName, parts)
    return own.groupBy(*COLUMNS, "normalized_title").agg(F.min_by("source_catalog", "position").alias("source_catalog"))
