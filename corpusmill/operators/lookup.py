"""Records by id, documents by title, and draws over buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A draw counts rows by bucket on the driver; more buckets than this are refused.
MOST_BUCKETS = 10_000


def records_by_id(banks: list[DataFrame], wanted: list[str], key: str = "record_id") -> DataFrame:
    """wanted, bank, record_id: the record of that id, or else one that holds the part after the id's last hyphen.

    Banks go in their order, and in a bank the smallest id; what is not found has no row. ``wanted`` is a list of the
    caller, tried on each record as it is scanned: nothing is joined, and one row for each id found leaves a task.
    """
    asked = F.array(*(F.struct(F.lit(w).alias("id"), F.lit(w.rpartition("-")[2]).alias("part")) for w in dict.fromkeys(wanted)))
    found = None
    for i, bank in enumerate(banks):
        own = F.col("record_id")
        meets = F.explode(F.filter(asked, lambda w: F.contains(own, w["part"])))
        rows = bank.select(F.col(key).cast("string").alias("record_id")).select("record_id", meets.alias("w"), F.lit(i).alias("bank"))
        found = rows if found is None else found.unionByName(rows)
    best = F.min(F.struct((F.col("w.id") != F.col("record_id")).alias("other"), "bank", "record_id"))
    return found.groupBy(F.col("w.id").alias("wanted")).agg(best.alias("b")).select("wanted", "b.bank", "b.record_id")


def documents_by_title(manifest: DataFrame, chunks: DataFrame, wanted: DataFrame, previews: int = 3, size: int = 320) -> DataFrame:
    """Of each title wanted: ``title`` of the manifest row that has it as an alias, and headings and shortened texts of its first chunks.

    ``manifest``: title; ``chunks``: title, position, heading, text; ``wanted``: title. Of rows with one alias the last title holds.
    Chunks of other documents do not reach the shuffle of the aggregate where the titles found are few; those beyond ``previews`` are cut before it.
    """
    aliases = manifest.select("title", F.explode(T.title_aliases(F.col("title"))).alias("alias")).groupBy("alias").agg(F.max("title").alias("title"))
    asked = wanted.select(F.col("title").alias("wanted"), T.normalize_title(F.col("title")).alias("alias")).distinct().join(aliases, "alias").select("wanted", "title")
    order = Window.partitionBy("title").orderBy("position")
    first = chunks.join(asked.select("title").distinct(), "title", "left_semi").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= previews)
    shown = first.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("k", "heading", T.truncate_text(F.col("text"), size).alias("text")))).alias("shown"))
    none = F.array().cast("array<string>")
    part = lambda name: F.coalesce(F.transform("shown", lambda x: F.coalesce(x[name], F.lit(""))), none)
    return asked.join(shown, "title", "left").select("wanted", "title", part("heading").alias("headings"), part("text").alias("texts"))


def draw_quotas(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """How many rows a draw takes of each bucket: one in turn, buckets by name, those that are empty leave.

    After a bucket has left, the draw goes on at the turns so far modulo the buckets that remain. Rounds in which no bucket empties are taken at once.
    """
    if sum(sizes.values()) < limit:
        raise ValueError(f"{limit} rows wanted of {sum(sizes.values())}")
    active, left, drawn, turn = sorted(b for b, n in sizes.items() if n > 0), dict(sizes), 0, 0
    while drawn < limit:
        rounds = min(min(left[b] for b in active) - 1, (limit - drawn) // len(active))
        if rounds > 0:
            for b in active:
                left[b] -= rounds
            drawn, turn = drawn + rounds * len(active), turn + rounds * len(active)
            continue
        bucket = active[turn % len(active)]
        left[bucket], drawn = left[bucket] - 1, drawn + 1
        if left[bucket]:
            turn += 1
        else:
            active.remove(bucket)
            turn %= max(len(active), 1)
    return {b: n - left[b] for b, n in sizes.items() if n > left[b]}


def balanced_draw(df: DataFrame, bucket: str, order: list, limit: int) -> DataFrame:
    """``limit`` rows over the buckets in turn, the last by ``order`` first; ``draw`` counts them in a bucket from 1.

    ``order``: columns, descending, that leave no ties. A constant rank limit cuts every bucket before its rows are shuffled.
    """
    if limit <= 0:
        return df.withColumn("draw", F.lit(1)).filter("false")
    sizes = {r[0]: r[1] for r in df.groupBy(bucket).agg(F.count("*")).limit(MOST_BUCKETS + 1).collect()}
    if len(sizes) > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    quotas = draw_quotas(sizes, limit)
    ranked = df.withColumn("draw", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("draw") <= max(quotas.values()))
    return ranked.filter(F.col("draw") <= F.try_element_at(F.create_map(*(F.lit(x) for p in quotas.items() for x in p)), F.col(bucket)))
