"""Ingest by micro-batches with counters of each batch that survive a restart.

The counters of a batch are written after its rows, in a folder named by its number: a batch
that is run again replaces rows and counters alike, so sums over the folder are right at
any time. The listener shows what runs now: it starts from the stored sums and adds the
batches it hears of.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

COUNTERS = "batch bigint, rows_in bigint, rows_written bigint, rows_failed bigint"


def ingest(stream: DataFrame, root: str, valid: Column, **trigger: object) -> StreamingQuery:
    """Start writing ``stream``: rows for which ``valid`` is true to ``root``/rows, others to ``root``/failed, counters to ``root``/counters."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ok = F.coalesce(valid, F.lit(False))
        batch.withColumn("_ok", ok).write.mode("overwrite").partitionBy("_ok").parquet(f"{root}/batches/batch={number}")
        schema = batch.schema.add("_ok", "boolean")
        seen = spark.read.schema(schema).parquet(f"{root}/batches/batch={number}").agg(F.count("*").alias("n"), F.count_if("_ok").alias("ok")).first()
        spark.createDataFrame([(number, seen["n"], seen["ok"], seen["n"] - seen["ok"])], COUNTERS).coalesce(1).write.mode("overwrite").json(f"{root}/counters/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def rows(spark: SparkSession, root: str, ok: bool = True) -> DataFrame:
    """All rows written so far, or those that failed."""
    return spark.read.option("basePath", f"{root}/batches").parquet(f"{root}/batches").filter(F.col("_ok") == ok).drop("_ok")


def counters(spark: SparkSession, root: str) -> DataFrame:
    """One row for each batch that has been written as a whole."""
    try:
        return spark.read.schema(COUNTERS).json(f"{root}/counters/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTERS)


class Progress(StreamingQueryListener):
    """Batches and rows of queries since their first start, by name; ``known`` has what earlier runs counted (``totals``)."""

    def __init__(self, known: dict[str, dict[str, int]] | None = None):
        self.by_name = {k: dict(v) for k, v in (known or {}).items()}
        self.seen: set[tuple[str, int]] = set()
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event: object) -> None:
        self.by_name.setdefault(event.name or str(event.id), {"batches": 0, "rows_in": 0})

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        if (str(p.runId), p.batchId) in self.seen or not p.numInputRows:
            return
        self.seen.add((str(p.runId), p.batchId))
        own = self.by_name.setdefault(p.name or str(p.id), {"batches": 0, "rows_in": 0})
        own["batches"] += 1
        own["rows_in"] += p.numInputRows

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.ended[str(event.runId)] = event.exception


def totals(spark: SparkSession, root: str) -> dict[str, int]:
    """Batches and rows so far, as stored."""
    got = counters(spark, root).agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_in", "rows_written", "rows_failed"))).first()
    return got.asDict()
