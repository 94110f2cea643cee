"""A stored inverted index: BM25 and overlap search that read the postings of the asked terms only.

Tables of a version: ``docs`` (id, dl and columns to keep), ``blocks`` (folders by a
hash of the term; one row for up to BLOCK postings of a term, sorted, with the largest
score a posting of the block can have for idf 1) and ``terms`` (df, idf, the largest
of its blocks). Documents are dealt to shards by id, so that a term in very many
documents is written by several tasks and never sorted whole in one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..sources.published import Version, Writer, load_or_build
from ..store import materialise
from .ranking import B, EPSILON, K1

#: Postings of a block, documents of a shard, and documents for each folder of terms (at most MAX_BUCKETS).
BLOCK, SHARD_DOCS, BUCKET_DOCS, MAX_BUCKETS = 128, 1_000_000, 20_000, 4096
#: Groups of postings for each task that sorts them, at least.
SLICES = 4
SCHEMA_VERSION = 1


def counted(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens: sorted once, cut where the term changes."""
    runs = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    cut = lambda s, r: F.transform(r, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(r, k + 1), F.size(s)) - p).alias("tf")))
    bind = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  computes ``value`` once
    return bind(F.array_sort(tokens), lambda s: bind(runs(s), lambda r: cut(s, r)))


def _part(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(writer: Writer, docs: DataFrame, id_: str, text: str, keep: list[str]) -> None:
    """Write the index of ``docs``. Null texts have no tokens; rows with a null id are left out; ids are to be unique."""
    parts = max(int(writer.spark.conf.get("spark.sql.shuffle.partitions")), writer.spark.sparkContext.defaultParallelism)
    # a file of one row group is read by one task: texts are dealt before they are cut, which is done once
    own = docs.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("_text"), *keep).repartition(parts, "id")
    own = own.select("id", *keep, word_tokens(F.coalesce(F.col("_text"), F.lit(""))).alias("t"))
    own = materialise(own.select("id", F.size("t").alias("dl"), *keep, counted(F.col("t")).alias("counts")), "tokens")
    held = writer.write("docs", own.select("id", "dl", *keep))
    n, avgdl = held.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    buckets = min(MAX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, n / BUCKET_DOCS)))))
    shards = max(1, math.ceil(n / SHARD_DOCS))
    posts = own.select("id", "dl", F.inline("counts"))
    posts = posts.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # where folders and shards are fewer than tasks, a folder's terms are dealt to several of them
    slices = math.ceil(SLICES * parts / (buckets * shards))
    part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(slices))
    group = ("bucket", "shard", "part", "term")  # what rows are dealt by is among them, so that they are dealt once
    place = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
    dealt = posts.withColumn("part", part).repartition(parts, "bucket", "shard", "part").withColumn("block", F.floor((place - 1) / BLOCK).cast("int"))
    blocks = dealt.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("posts"), F.max(_part(F.col("tf"), F.col("dl"), avgdl or 1.0)).alias("most"))
    written = writer.write("blocks", blocks.drop("part").sortWithinPartitions("bucket", "term", "shard", "block"), "bucket")
    df = written.groupBy("bucket", "term").agg(F.sum(F.size("posts")).alias("df"), F.max("most").alias("most"), F.max(F.array_max(F.transform("posts", lambda p: p["tf"]))).alias("max_tf"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    terms = writer.write("terms", raw.sortWithinPartitions("bucket", "term"), "bucket")
    mean = terms.agg(F.coalesce(F.avg("raw"), F.lit(0.0))).first()[0]
    writer.facts |= {"n": float(n), "avgdl": float(avgdl or 1.0), "mean": float(mean), "buckets": float(buckets)}


class Inverted:
    """An index as it was published."""

    def __init__(self, spark: SparkSession, version: Version):
        self.spark, self.version, self.facts = spark, version, version.facts

    def docs(self) -> DataFrame:
        return self.version.read(self.spark, "docs")

    def terms(self) -> DataFrame:
        """term, df, idf, max_tf of the whole vocabulary; weights below 0 become EPSILON times the mean."""
        idf = F.when(F.col("raw") < 0, EPSILON * self.facts["mean"]).otherwise(F.col("raw"))
        return self.version.read(self.spark, "terms").select("term", "df", "raw", idf.alias("idf"), "max_tf", "most", "bucket")

    def _asked(self, df: DataFrame, terms: list[str]) -> DataFrame:
        """Only the folders of the asked terms, and of these only the row groups that may hold them."""
        return df.filter(F.col("bucket").isin(*(_bucket(F.lit(t), int(self.facts["buckets"])) for t in terms)) & F.col("term").isin(*terms))

    def blocks(self, terms: list[str]) -> DataFrame:
        return self._asked(self.version.read(self.spark, "blocks"), terms)

    def postings(self, terms: list[str]) -> DataFrame:
        """term, id, tf, dl of the asked terms."""
        return self.blocks(terms).select("term", F.inline("posts"))

    def weights(self, terms: list[str]) -> dict[str, tuple[float, float]]:
        """idf of those asked terms that occur, and the largest score that one of its postings has."""
        rows = self._asked(self.terms(), terms).select("term", "idf", F.col("most") * F.col("idf")).collect()  # a row for each asked term at most
        return {t: (idf, most) for t, idf, most in rows}

    def bm25(self, terms: list[str], at_least: float | None = None) -> DataFrame:
        """(id, score) of documents that hold an asked term; with ``at_least``, of those that score so much.

        Then blocks are left out whose best posting, with the best of all other terms, stays below it: all blocks of a document that reaches it are kept.
        """
        terms = sorted(set(terms))
        part = _part(F.col("tf"), F.col("dl"), self.facts["avgdl"])
        if at_least is None:
            idf = self._asked(self.terms(), terms).select("term", "idf")  # a row for each asked term at most
            hits = self.postings(terms).join(F.broadcast(idf), "term")
            return hits.groupBy("id").agg(F.round(F.sum(F.col("idf") * part), 6).alias("score"))
        known = self.weights(terms)
        if not known:
            return self.docs().filter("false").select("id", F.lit(0.0).alias("score"))
        idf = F.create_map(*(F.lit(x) for t, (w, _) in known.items() for x in (t, w)))[F.col("term")]
        others = sum(max(m, 0.0) for _, m in known.values())
        rest = F.create_map(*(F.lit(x) for t, (_, m) in known.items() for x in (t, others - max(m, 0.0))))[F.col("term")]
        hits = self.blocks(list(known)).filter(idf * F.col("most") + rest >= at_least - 1e-6).select("term", F.inline("posts"))
        return hits.groupBy("id").agg(F.round(F.sum(idf * part), 6).alias("score")).filter(F.col("score") >= at_least)

    def overlap(self, terms: list[str], title: str) -> DataFrame:
        """The kept columns and the share of asked terms in each document that has one, +0.1 where one of those is in its title."""
        asked = set(terms)
        found = self.postings(sorted(asked)).groupBy("id").agg(F.collect_list("term").alias("hit"))
        bonus = F.when(F.exists("hit", lambda t: F.contains(F.lower(F.col(title)), t)), 0.1).otherwise(0.0)
        return self.docs().join(found, "id").withColumn("score", F.round(F.size("hit") / len(asked) + bonus, 4)).drop("hit", "dl")


def open_index(spark: SparkSession, root: str, sources: list[str], docs: DataFrame, id_: str, text: str, keep: list[str]) -> Inverted:
    """The index of ``docs``, which are read from ``sources``: as it is stored, or built if it is missing or stale."""
    return Inverted(spark, load_or_build(spark, root, sources, lambda w: build(w, docs, id_, text, keep), SCHEMA_VERSION))
