"""Hot updates of a bank, touches of memories and session state, as streams.

A bank takes updates as a log: each micro-batch is one folder named by its number, so a
batch that is run again replaces itself, and nothing old is rewritten. Readers take the
latest row of each key; ``compact`` folds the log into one table now and then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = "batch"


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by ``order``; one partial and one final aggregate. Rows with a null key are left out."""
    last = F.max_by(F.struct("*"), F.struct(*order)).alias("row")
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(last).select("row.*")


def log_updates(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start writing ``stream`` to the log at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, key: str, *order: str) -> DataFrame:
    """The bank as of now: of each key the last row by ``order``, then by batch."""
    return latest(spark.read.parquet(path), key, *order, BATCH).drop(BATCH)


def compact(spark: SparkSession, path: str, target: str, key: str, *order: str) -> None:
    """Write the bank as of now as batch -1 of a new log at ``target``."""
    current(spark, path, key, *order).write.parquet(f"{target}/{BATCH}=-1")


def touches(events: DataFrame, key: str, at: str) -> DataFrame:
    """Number and last time of accesses by key; for batches, and for streams in complete or update mode."""
    return events.groupBy(key).agg(F.count("*").alias("hits"), F.max(at).alias("last_access"))


def _fold(keep: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, turns, texts = state.get if state.exists else (0, [], [])
        held = list(zip(turns, texts))
        for part in parts:
            n += len(part)
            held = sorted([*held, *zip(part["turn"].tolist(), part["text"].fillna("").tolist())])[-keep:]
        turns, texts = [int(t) for t, _ in held], [x for _, x in held]
        state.update((n, turns, texts))
        yield pd.DataFrame({"session": [key[0]], "n_turns": [n], "last_turns": [turns], "last_texts": [texts]})

    return run


def session_state(turns: DataFrame, session: str, keep: int = 3) -> DataFrame:
    """Stream of session, n_turns, last_turns, last_texts after each batch (update mode).

    Takes ``session``, turn and text; the state of a session is a count and its last ``keep`` turns, however long it grows.
    """
    own = turns.select(F.col(session).cast("string").alias("session"), F.col("turn").cast("bigint").alias("turn"), "text").filter("session is not null and turn is not null")
    return own.groupBy("session").applyInPandasWithState(
        _fold(keep), "session string, n_turns bigint, last_turns array<bigint>, last_texts array<string>", "n bigint, turns array<bigint>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )
