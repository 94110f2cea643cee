"""JSON Lines: scans with a fixed schema, and writes that replace a table as a whole or add to it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line that is not blank; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``; a path that does not exist is an empty table."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then rename: readers see the old table or the new one, and ``df`` may read ``path``."""
    spark = df.sparkSession
    path, mark = path.rstrip("/"), uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.json(new)
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(name(path))
    if there and not fs.rename(name(path), name(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(name(new), name(path)):
        raise OSError(f"cannot move {new} to {path}")
    if there:
        fs.delete(name(old), True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def insert_missing(bank: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``bank`` and those rows of ``new`` whose key it lacks, one for each key; rows with a null key are left out."""
    return bank.unionByName(new.filter(new[key].isNotNull()).dropDuplicates([key]).join(bank.select(key), key, "left_anti"), allowMissingColumns=True)
