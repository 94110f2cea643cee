"""Memories: scores, decay, edges between them, bonuses over the graph, quotas by layer, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Base scores and quotas of layers; limits of the graph.
LAYER_BASE = {"profile": 1.0, "system": 0.94, "working": 0.9, "long_term": 0.88, "summary": 0.84, "episodic": 0.74, "semantic": 0.72}
QUOTAS = {"profile": 3, "system": 2, "working": 4, "long_term": 4, "summary": 4, "episodic": 4, "semantic": 4}
ANCHORED, STEADY = ("profile", "system", "working"), ("profile", "system")
MIN_WEIGHT, NEIGHBOURS, ANCHORS, HOPS = 0.18, 8, 10, 3
MERGE = 0.82
BUCKETS = 256


def of_layer(layer: Column, values: dict, default: float | int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), layer), F.lit(default))


def lexical(query: Column, own: Column) -> Column:
    """Share of the query's distinct tokens that are among a memory's; both are arrays of tokens."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, own)).cast("double") / F.size(F.array_distinct(query)))


def recency(layer: Column, idle_days: Column) -> Column:
    return F.when(layer.isin(*STEADY), 1.0).otherwise(F.greatest(F.lit(0.1), 1 - F.least(F.lit(0.75), idle_days * 0.025)))


def decayed(layer: Column, importance: Column, age_days: Column, idle_days: Column, hits: Column) -> Column:
    """Importance after its decay by layer and its recovery by hits, within .05 and 1."""
    loss = lambda cap, a, b: F.least(F.lit(cap), age_days * a + idle_days * b)
    decay = F.when(layer == "long_term", loss(0.22, 0.0015, 0.004)).when(layer == "summary", loss(0.28, 0.0025, 0.007)).otherwise(loss(0.35, 0.003, 0.01))
    recovery = F.least(F.lit(0.18), F.log1p(F.greatest(hits, F.lit(0))) * 0.05)
    return F.when(layer.isin(*STEADY), importance).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), importance - decay + recovery)))


def hit_bonus(hits: Column) -> Column:
    return F.least(F.lit(0.25), F.log1p(F.greatest(hits, F.lit(0))) * 0.08)


def score(lexical_: Column, vector: Column, importance: Column, fresh: Column, layer: Column, hits: Column) -> Column:
    return 0.34 * lexical_ + 0.24 * vector + 0.18 * importance + 0.10 * fresh + 0.08 * of_layer(layer, LAYER_BASE, 0.5) + 0.06 * hit_bonus(hits)


def gated(layer: Column, lexical_: Column, vector: Column, relation: Column, final: Column) -> Column:
    """Whether a hit counts: anchored layers always; others need some relation to the query and a score."""
    return layer.isin(*ANCHORED) | (((lexical_ >= 0.01) | (vector >= 0.08) | (relation >= 0.05)) & (final >= MIN_WEIGHT))


def hashed(tokens: DataFrame, token: str, *keys: str) -> DataFrame:
    """Signed feature hashing: (keys, bucket, value), rows of ``tokens`` summed by bucket, the first byte of a token's md5; the parity of the fifth is its sign."""
    byte = lambda k: F.conv(F.substring(F.md5(F.col(token).cast("binary")), 2 * k + 1, 2), 16, 10).cast("int")
    return tokens.groupBy(*keys, byte(0).alias("bucket")).agg(F.sum(F.when(byte(4) % 2 == 0, 1).otherwise(-1)).alias("value"))


def cosines(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Cosine, 0 at least, of the hashed vectors of equal keys; without a row where nothing is shared or it is not above 0."""
    norm = lambda df, name: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias(name))
    dot = a.join(b.withColumnRenamed("value", "other"), [*keys, "bucket"]).groupBy(*keys).agg(F.sum(F.col("value") * F.col("other")).alias("dot"))
    return dot.join(norm(a, "na"), list(keys)).join(norm(b, "nb"), list(keys)).filter("dot > 0").select(*keys, F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))), 6).alias("cosine"))


def _ratio(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)).cast("double") / both).otherwise(0.0)


def edge_weight(a: str, b: str) -> Column:
    """Of two memories in columns with prefixes ``a`` and ``b``: shared references, tags and keywords, session, category and layer; .95 at most."""
    own = lambda c: (F.col(a + c), F.col(b + c))
    refs = F.size(F.array_intersect(*own("refs")))
    tags, words = _ratio(*own("tags")), _ratio(*own("keywords"))
    same = lambda c: F.coalesce(F.col(a + c) == F.col(b + c), F.lit(False))
    anchored = F.col(a + "layer").isin(*ANCHORED) | F.col(b + "layer").isin(*ANCHORED)
    signals = (
        F.when(refs > 0, F.least(F.lit(0.5), 0.28 + refs * 0.08)), F.when(tags > 0, F.least(F.lit(0.28), 0.08 + tags * 0.22)), F.when(words > 0, F.least(F.lit(0.18), 0.05 + words * 0.16)), F.when(same("session"), 0.06), F.when(same("category"), 0.04),
        F.when(same("layer") & F.col(a + "layer").isin("long_term", "summary", "semantic"), 0.04), F.when(anchored & ((refs > 0) | (tags > 0) | (words > 0)), 0.06),
    )
    return F.least(F.lit(0.95), sum(F.coalesce(s, F.lit(0.0)) for s in signals))


def edges(memories: DataFrame) -> DataFrame:
    """(user, a, b, weight) with a < b and weight of MIN_WEIGHT or more.

    Without a shared reference, tag or keyword a weight stays below that, so memories meet by
    those keys alone and no pair is lost. A pair is made by its least common key only, so that it
    comes once and need not be made distinct; a key that very many memories of a user share is split
    by adaptive skew joins.
    """
    keys = F.concat(F.transform("refs", lambda x: F.concat(F.lit("r:"), x)), F.transform("tags", lambda x: F.concat(F.lit("t:"), x)), F.transform("keywords", lambda x: F.concat(F.lit("k:"), x)))
    own = memories.select("user", "id", F.array_distinct(keys).alias("keys")).select("user", "id", "keys", F.explode("keys").alias("key"))
    own = own.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))  # a pair that shares one of these was made by it
    met = own.select("user", "key", F.col("id").alias("a"), F.col("keys").alias("before_a")).join(own.select("user", "key", F.col("id").alias("b"), F.col("keys").alias("before_b")), ["user", "key"])
    met = met.filter((F.col("a") < F.col("b")) & ~F.arrays_overlap("before_a", "before_b")).select("user", "a", "b")
    side = lambda p: memories.select("user", *(F.col(c).alias(f"{p}_{c}" if c != "id" else p) for c in ("id", "layer", "category", "session", "refs", "tags", "keywords")))
    pairs = met.join(side("a"), ["user", "a"]).join(side("b"), ["user", "b"])
    return pairs.select("user", "a", "b", F.round(edge_weight("a_", "b_"), 6).alias("weight")).filter(F.col("weight") >= MIN_WEIGHT)


def both_ways(edges_: DataFrame) -> DataFrame:
    return edges_.select("user", F.col("a").alias("source"), F.col("b").alias("target"), "weight").union(edges_.select("user", "b", "a", "weight"))


def neighbours(edges_: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """The n heaviest edges from each memory."""
    rank = F.row_number().over(Window.partitionBy("user", "source").orderBy(F.desc("weight"), "target"))
    return both_ways(edges_).withColumn("rank", rank).filter(F.col("rank") <= n)


def graph_bonus(memories: DataFrame, edges_: DataFrame) -> DataFrame:
    """(user, id, bonus): from ANCHORS memories of a user by base score, over one edge min(.24, .05 + .22 w), over two .12 w w' (.12 at most), times the anchor's score; the best holds.

    ``memories``: user, id, layer, importance, base.
    """
    steady = F.col("layer").isin(*STEADY)
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("base"), F.desc("importance"), "id"))
    anchors = memories.filter((F.col("base") >= MIN_WEIGHT) | steady).withColumn("rank", rank).filter(F.col("rank") <= ANCHORS)
    anchors = anchors.select("user", F.col("id").alias("source"), F.when(steady, F.greatest("base", F.least("importance", F.lit(0.72)))).otherwise(F.col("base")).alias("s")).filter("s > 0")
    near = neighbours(edges_)
    one = anchors.join(near, ["user", "source"]).select("user", "source", "s", F.col("target").alias("id"), "weight")
    hop = near.filter(F.col("rank") <= HOPS).select("user", F.col("source").alias("id"), F.col("target").alias("hop"), F.col("weight").alias("w2"))
    two = one.join(hop, ["user", "id"]).filter("hop <> source AND hop <> id")
    direct = one.select("user", "id", (F.col("s") * F.least(F.lit(0.24), 0.05 + F.col("weight") * 0.22)).alias("bonus"))
    far = two.select("user", F.col("hop").alias("id"), F.least(F.lit(0.12), F.col("s") * F.col("weight") * F.col("w2") * 0.12).alias("bonus"))
    return direct.union(far).groupBy("user", "id").agg(F.round(F.max("bonus"), 6).alias("bonus"))


def by_quota(hits: DataFrame, user: str, *order: Column, quotas: dict[str, int] = QUOTAS, default: int = 3) -> DataFrame:
    """The best hits of each layer, as many as its quota."""
    own = hits.withColumn("rank", F.row_number().over(Window.partitionBy(user, "layer").orderBy(*order)))
    return own.filter(F.col("rank") <= max(*quotas.values(), default)).filter(F.col("rank") <= of_layer(F.col("layer"), quotas, default))


def merged_hits(groups: list[DataFrame], id_: str, order: str, limit: int) -> DataFrame:
    """Hits of several lists, earlier lists first, each id once, ``limit`` in all."""
    first = None
    for k, g in enumerate(groups):
        part = g.select(id_, order).orderBy(order).limit(limit).withColumn("list", F.lit(k))
        first = part if first is None else first.unionByName(part)
    return first.groupBy(id_).agg(F.min(F.struct("list", order)).alias("at")).orderBy("at").limit(limit).select(id_, "at.list", F.col("at." + order).alias(order))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    kept: list[dict] = []
    for r in rows.sort_values(["at", "id"]).itertuples():
        own, bare = set(r.tokens), "".join(r.text.split())
        for k in reversed(kept) if r.layer not in ("episodic", "working") else ():
            if r.layer in ("summary", "semantic") and k["session"] != r.session:
                continue
            if k["bare"] == bare or own and k["set"] and len(own & k["set"]) / len(own | k["set"]) >= MERGE:
                k["merged"] += 1
                k["importance"] = max(k["importance"], r.importance)
                if len(r.text) > len(k["text"]):
                    k.update(text=r.text, bare=bare, set=own)
                break
        else:
            kept.append({"user": r.user, "id": r.id, "layer": r.layer, "category": r.category, "session": r.session, "text": r.text, "importance": r.importance, "merged": 1, "set": own, "bare": bare})
    columns = ["user", "id", "layer", "category", "text", "importance", "merged"]
    return pd.DataFrame([{c: k[c] for c in columns} for k in kept], columns=columns)


def merge_memories(memories: DataFrame) -> DataFrame:
    """Rows of user, id, layer, category, session, text, importance, at become one for each different memory, with the number merged.

    In order of time a memory joins the latest before it that has its layer and category and equal
    text but for white space, or tokens alike by MERGE; the longer text stays. Episodic and working
    memories never merge, summaries and semantic ones within a session only. The order decides, so
    each layer and category of a user is folded by itself.
    """
    own = memories.select("user", "id", "layer", "category", "session", "text", "importance", "at", T.tokens(F.col("text")).alias("tokens"))
    return own.groupBy("user", "layer", "category").applyInPandas(_merge, "user bigint, id bigint, layer string, category string, text string, importance double, merged bigint")


#: Categories of a profile's memories, how they read, and their importance.
PROFILE = (("study_goal", "goals", "用户当前备考目标：", 0.96), ("weak_point", "weak", "用户薄弱点：", 0.94), ("strong_point", "strong", "用户强项：", 0.84))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """A user's goals, weak and strong points, preferences and last three notes as memory rows. Takes user, goals, weak, strong, preferences (entries ``key=value``) and notes."""
    made = lambda category, text, importance: F.struct(F.lit(category).alias("category"), text.alias("text"), F.lit(importance).alias("importance"))
    listed = lambda category, column, start, importance: F.transform(column, lambda x: made(category, F.concat(F.lit(start), x), importance))
    lists = [listed(*p) for p in PROFILE]
    preferences = F.transform("preferences", lambda e: made("preference", F.concat(F.lit("用户偏好 "), F.replace(e, F.lit("="), F.lit("："))), 0.9))
    last = F.slice("notes", F.greatest(F.size("notes") - 2, F.lit(1)), 3)
    own = profiles.select("user", F.explode(F.concat(*lists, preferences, F.transform(last, lambda x: made("note", F.concat(F.lit("用户备注："), x), 0.8)))).alias("m")).select("user", "m.*")
    return own.withColumn("id", F.substring(F.md5(F.concat_ws(":", F.lit("profile"), "category", "text").cast("binary")), 1, 12))
