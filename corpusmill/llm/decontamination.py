"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A document is contaminated by a test item when it holds at least 80 % of the
item's distinct five-word shingles. Items are partitioned by the size of their
shingle sets (powers of two). The sketch of an item is the bottom of its MinHash
order: the k smallest hashes of its set, k by partition so large that a document
with that containment must hold one of them (more than 20 % of the largest set of
the partition). Documents of any length are probed for sketch hashes, and
candidates are verified on the shingles themselves. DataFrame functions only.

Words are lower-cased and cut at 0x20 and 0x09-0x0D. An item or document of
fewer than five words is one shingle, its whole sequence. Null or empty texts,
items without words and null ids take no part. A doc_id or item_id that occurs
more than once counts with all its rows: the best of them is reported. No item, no
candidates or empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise, table

WORDS = 5
PERCENT = 80
#: A side of a join that is up to so many bytes as rows in memory is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _grams(tokens: Column, make) -> Column:
    """``make`` of each run (array) of WORDS tokens, or of all tokens if there are fewer; no grams without tokens."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: make(F.array(*(F.get(tokens, i + k) for k in range(WORDS)))))
    return F.when(n >= WORDS, runs).when(n > 0, F.array(make(tokens)))


def _spaced(run: Column) -> Column:
    return F.array_join(run, " ")


def _at_hand(df: DataFrame, texts: str | None = None) -> DataFrame:
    """``df`` (a written table), broadcast if its rows, by count and by the bytes of the strings in array column ``texts``, are few."""
    strings = F.lit(0) if texts is None else F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 16)
    size = df.agg(F.coalesce(F.sum(strings + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment: one row a contaminated document and item."""
    tokens = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text").cast("string")).alias("tokens")).filter("doc_id is not null")
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text").cast("string")).alias("tokens")).filter("item_id is not null and size(tokens) > 0")
    own = own.select("item_id", F.array_distinct(_grams(F.col("tokens"), _spaced)).alias("shingles")).withColumn("n_shingles", F.size("shingles").cast("bigint"))
    own = materialise(own, "items")
    # sketches: the bottom k hashes, k by size partition [2^p, 2^(p+1))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1).cast("bigint") - 1
    k = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    hashed = F.transform("shingles", lambda s: F.xxhash64(F.split(s, " ")))
    sketch = own.select("item_id", "n_shingles", k.alias("k"), F.sort_array(hashed).alias("hashes"))
    sketch = materialise(sketch.select("item_id", "n_shingles", F.explode(F.slice("hashes", 1, F.col("k"))).alias("h")), "sketch")

    probes = tokens.select("doc_id", F.explode(_grams(F.col("tokens"), F.xxhash64)).alias("h"))
    candidates = materialise(probes.join(_at_hand(sketch), "h").groupBy("doc_id", "item_id").agg(F.lit(1).alias("one")).select("doc_id", "item_id"), "candidates")

    pairs = tokens.join(_at_hand(candidates), "doc_id").join(_at_hand(own, "shingles"), "item_id")
    shared = F.size(F.array_intersect(F.col("shingles"), _grams(F.col("tokens"), _spaced))).cast("bigint")
    found = pairs.select("doc_id", "item_id", "n_shingles", shared.alias("n_shared")).filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHINGLES = "list_distinct(CASE WHEN len(tokens) >= 5 THEN list_transform(range(1, len(tokens) - 3), lambda i: array_to_string(tokens[i:i + 4], ' ')) WHEN len(tokens) > 0 THEN [array_to_string(tokens, ' ')] ELSE [] END)"
SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents WHERE doc_id IS NOT NULL)),
     i AS (SELECT item_id, {_SHINGLES} AS shingles FROM (SELECT item_id, {_TOKENS} AS tokens FROM benchmark WHERE item_id IS NOT NULL)),
     e AS (SELECT item_id, len(shingles)::BIGINT AS n_shingles, unnest(shingles) AS s FROM i)
SELECT doc_id, item_id, n_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_shingles AS containment
FROM d JOIN e USING (s) GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 100 >= n_shingles * 80
"""
