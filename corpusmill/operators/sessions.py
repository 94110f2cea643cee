"""Sessions as a log of turns: merges of histories, compression by a cursor, and profiles folded from updates.

All of it is grouped aggregates with partial sums, not a walk over a user's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..sources.published import Version, Writer, current

#: Turns before a session is compressed, turns of a chunk, and latest turns that stay as they are.
AFTER, CHUNK, RETAIN = 10, 8, 6


def turn_pairs(messages: DataFrame, session: str) -> DataFrame:
    """(session, turn, request, answer) of messages with turn (from 0), role and text: two messages are a turn. A missing side is empty."""
    side = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("text"))), F.lit(""))
    return messages.groupBy(F.col(session).alias("session"), F.floor(F.col("turn") / 2).cast("int").alias("turn")).agg(side("user").alias("request"), side("assistant").alias("answer"))


def chunks(turns: DataFrame, after: int = AFTER, chunk: int = CHUNK, retain: int = RETAIN) -> DataFrame:
    """(session, chunk, from_turn, to_turn, n_turns, turns): the chunks that a session with that many turns has compressed.

    The cursor moves by ``chunk`` when ``after`` turns are there and ``chunk`` of them are before the ``retain`` latest, so chunk k is made when turn (k + 1) * chunk + retain is.
    """
    place = F.row_number().over(Window.partitionBy("session").orderBy("turn")) - 1
    own = turns.withColumn("at", place).withColumn("chunk", F.floor(F.col("at") / chunk).cast("int"))
    counts = turns.groupBy("session").agg(F.count("*").alias("n"))
    made = (F.col("n") >= after) & ((F.col("chunk") + 1) * chunk + retain <= F.col("n"))
    parts = own.groupBy("session", "chunk").agg(F.min("at").alias("from_turn"), F.max("at").alias("to_turn"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "request", "answer"))).alias("turns"))
    return parts.join(counts, "session").filter(made).drop("n")


def compressed(turns: DataFrame, after: int = AFTER, chunk: int = CHUNK, retain: int = RETAIN) -> DataFrame:
    """``chunks`` with their summary, tags and open questions in place of the turns."""
    own = chunks(turns, after, chunk, retain)
    return own.withColumn("c", H.compressed_summary(F.col("turns"))).select("session", "chunk", "from_turn", "to_turn", "n_turns", "c.summary", "c.tags", "c.open_loops")


def merged_turns(log: DataFrame, *key: str, seq: str = "seq") -> DataFrame:
    """Of all rows written for a turn (``key``) the last by ``seq``, then by all columns. A write of fewer turns takes none away, and a row that comes twice or late changes nothing."""
    others = [c for c in log.columns if c not in (*key, seq)]
    whole = log.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    return whole.groupBy(*key).agg(F.max(F.struct(seq, *others)).alias("m")).select(*key, *(f"m.{c}" for c in (seq, *others)))


class TurnLog:
    """A log of turns on storage: a folder for each batch, which replaces itself if the batch is run again, and compacted versions beside them."""

    def __init__(self, spark: SparkSession, root: str, *key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")

    def _since(self, batch: int) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.root}/log").filter(F.col("batch") > batch).drop("batch")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def current(self) -> DataFrame:
        """The turns as of now: the last compacted version, merged with the batches after it."""
        last = current(self.spark, self.root)
        new = self._since(int(last.facts["batch"]) if last else -1)
        base = last.read(self.spark, "turns") if last else None
        if base is None and new is None:
            raise FileNotFoundError(self.root)
        both = new if base is None else base if new is None else base.unionByName(new)
        return merged_turns(both, *self.key)

    def compact(self) -> Version:
        """Publish the turns as of now; batches up to the latest are not read any more. Runs of one log are to follow each other."""
        top = self.spark.read.parquet(f"{self.root}/log").agg(F.max("batch")).first()[0]
        writer = Writer(self.spark, self.root)
        writer.write("turns", self.current())
        writer.facts["batch"] = float(top)
        return writer.publish(f"batch:{top}")


#: Fields of a profile that are lists without repeats.
LISTS = ("study_goals", "weak_points", "strong_points", "notes")


def folded_profiles(updates: DataFrame, *order: str) -> DataFrame:
    """(user, name, study_goals, weak_points, strong_points, notes, preferences, attributes) of updates (user, field, key, value), folded in order.

    Lists get each value that they lack, so they are the distinct values in order of first sight. Of the name and of each key of preferences
    (field ``preferences``) and attributes (any other field, which is the key) the last value holds. Null and empty values change nothing, nor does an update that comes twice.
    """
    at = F.struct(*order)
    own = updates.filter("user IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''").withColumn("value", F.trim("value"))
    is_list = F.col("field").isin(*LISTS)
    first = own.filter(is_list).groupBy("user", "field", "value").agg(F.min(at).alias("at"))
    lists = first.groupBy("user", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    wide = lists.groupBy("user").agg(*(F.max(F.when(F.col("field") == f, F.col("values"))).alias(f) for f in LISTS))
    key = F.when(F.col("field") == "preferences", F.col("key")).otherwise(F.col("field"))
    last = own.filter(~is_list).withColumn("key", key).filter("key IS NOT NULL").groupBy("user", "field", "key").agg(F.max_by("value", at).alias("value"))
    pairs = lambda which: F.map_from_entries(F.array_sort(F.collect_list(F.when(which, F.struct("key", "value")))))
    maps = last.groupBy("user").agg(F.max(F.when(F.col("field") == "name", F.col("value"))).alias("name"), pairs(F.col("field") == "preferences").alias("preferences"), pairs(~F.col("field").isin("name", "preferences")).alias("attributes"))
    none = F.array().cast("array<string>")
    joined = wide.join(maps, "user", "full_outer")
    empty: Column = F.create_map().cast("map<string,string>")
    return joined.select("user", "name", *(F.coalesce(f, none).alias(f) for f in LISTS), F.coalesce("preferences", empty).alias("preferences"), F.coalesce("attributes", empty).alias("attributes"))
