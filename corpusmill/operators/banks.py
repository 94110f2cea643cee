"""Banks built anew out of candidates, on top of what people have written into them."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..store import materialise


def preserved(bank: DataFrame, id_: str, prefix: str) -> DataFrame:
    """The rows that no build has made: generated ids begin with ``prefix``. A row without an id stays."""
    return bank.filter(~F.coalesce(F.col(id_).startswith(prefix), F.lit(False)))


def accepted(candidates: DataFrame, order: str, keys: list[str], seen: dict[str, DataFrame]) -> DataFrame:
    """Candidates in ``order`` (unique) that share none of their ``keys`` with ``seen`` or with one accepted before them.

    What comes first of all that is left, by each of its keys, is accepted, and what shares a key with it goes; so on until nothing is left.
    Only chains of candidates that exclude each other by turns take more than two rounds. Null keys exclude nothing.
    """
    left = candidates
    for k in keys:
        left = left.join(seen[k].select(k).distinct(), k, "left_anti")
    left, out = materialise(left, "candidates"), None
    while True:
        firsts = left
        for k in keys:
            first = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("_first"))
            firsts = firsts.join(first.withColumnRenamed("_first", f"_{k}"), k, "left")
        is_first = F.lit(True)
        for k in keys:
            is_first = is_first & (F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(order)))
        won = materialise(firsts.filter(is_first).select(candidates.columns), "accepted")
        out = won if out is None else out.unionByName(won)
        rest = left.join(won.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(won.select(k), k, "left_anti")
        left = materialise(rest.select(candidates.columns), "candidates")
        if left.isEmpty():
            return out


def rebuilt_questions(candidates: DataFrame, bank: DataFrame, order: str, prefix: str, target: int) -> DataFrame:
    """(id, type, question, generated): the preserved questions, then accepted candidates in order up to ``target`` rows in all. Neither an id nor a type with its question comes twice."""
    kept = materialise(preserved(bank, "id", prefix).select("id", "type", "question"), "preserved")
    key = F.concat_ws("::", F.coalesce("type", F.lit("single_choice")), F.coalesce("question", F.lit("")))
    won = accepted(candidates.select("id", "type", "question", order).withColumn("key", key), order, ["id", "key"], {"id": kept, "key": kept.withColumn("key", key)})
    room = max(0, target - kept.count())
    new = won.orderBy(order).limit(room).select("id", "type", "question")
    return kept.withColumn("generated", F.lit(False)).unionByName(new.withColumn("generated", F.lit(True)))


def titled_cases(candidates: DataFrame, bank: DataFrame, order: str, sample: str) -> DataFrame:
    """``candidates`` (id, title, ...) with an id that neither the bank nor an earlier one has; a title that was there before gets the last six characters of ``sample`` in brackets."""
    first = Window.partitionBy("id").orderBy(order)
    own = candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(bank.select("id"), "id", "left_anti")
    known = bank.select("title", F.lit(True).alias("_known")).distinct()
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("title").orderBy(order))).join(known, "title", "left")
    again = (F.col("_n") > 1) | F.col("_known").isNotNull()
    end = F.substring(sample, -6, 6)
    return own.withColumn("title", F.when(again, F.concat("title", F.lit("（"), end, F.lit("）"))).otherwise(F.col("title"))).drop("_n", "_known")


def summary(banks: dict[str, DataFrame]) -> DataFrame:
    """(bank, n): rows of each bank."""
    out = None
    for name, df in banks.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("bank"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def flattened(pools: DataFrame, topics: list[str], group: str, order: str) -> DataFrame:
    """``pools`` with their ``position`` (from 0) when they are laid one after another in the order of ``topics``; groups that aren't listed are left out."""
    place = F.create_map(*(x for i, t in enumerate(topics) for x in (F.lit(t), F.lit(i))))[F.col(group)]
    own = pools.withColumn("_place", place).filter("_place IS NOT NULL")
    sizes = own.groupBy("_place").agg(F.count("*").alias("_n"))  # a row a topic
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_place").orderBy(order)) - 1
    return own.withColumn("_rank", rank).join(F.broadcast(before), "_place").withColumn("position", F.col("_before") + F.col("_rank")).drop("_place", "_rank", "_before")


def stable_score(value: Column) -> Column:
    """The first eight bytes of the text's BLAKE2b digest of that length, as an unsigned number."""
    score = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else _score(v)), DecimalType(20, 0))
    return score(value)


def _score(text: str) -> Decimal:
    return Decimal(int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=8).digest(), "big"))
