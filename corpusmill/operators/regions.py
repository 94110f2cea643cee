"""Region trees with interval labels, and places named by their parts.

Each node gets ``enter`` and ``leave``: a node is below another if its ``enter`` lies within the other's interval, so
that ancestry is a range test and no walk. Labels are made level by level: sizes upwards, then places downwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialise

#: Levels of the tree, from the root down.
LEVELS = ("province", "prefecture", "county")


def labelled(nodes: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``nodes`` (id, parent, name, level) with enter and leave. Nodes whose parent is missing are roots; a node's level is to be below its parent's."""
    known = nodes.select(F.col("id").alias("parent")).distinct()
    own = materialise(nodes.join(known.withColumn("there", F.lit(True)), "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there"), "regions")
    sizes = None
    for level in reversed(levels):
        part = own.filter(F.col("level") == level)
        below = sizes.filter("parent IS NOT NULL").groupBy("parent").agg(F.sum("size").alias("below")).withColumnRenamed("parent", "id") if sizes is not None else None
        part = part.join(below, "id", "left") if below is not None else part.withColumn("below", F.lit(None).cast("bigint"))
        part = part.select("id", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
        sizes = part if sizes is None else sizes.unionByName(part)
    sizes = materialise(sizes, "sizes")
    before = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = offset.filter("parent IS NULL").select("id", F.col("skip").alias("enter"), "size")
    open_ = placed
    for _ in levels[1:]:
        open_ = offset.alias("c").join(open_.alias("p"), F.col("c.parent") == F.col("p.id")).select("c.id", (F.col("p.enter") + 1 + F.col("c.skip")).alias("enter"), "c.size")
        placed = placed.unionByName(open_)
    return own.join(placed, "id").select(*nodes.columns, "enter", (F.col("enter") + F.col("size")).alias("leave"))


def _chains(tree: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(id, name, level, chain): a node's name and those of all nodes above it."""
    own = tree.select("id", "parent", "name", "level", F.array_compact(F.array("name")).alias("chain"))
    above = own.filter(F.col("level") == levels[0])
    for level in levels[1:]:
        part = own.filter(F.col("level") == level).join(above.select(F.col("id").alias("parent"), F.col("chain").alias("up")), "parent", "left")
        above = above.unionByName(part.select("id", "parent", "name", "level", F.array_distinct(F.concat("chain", F.coalesce("up", F.array().cast("array<string>")))).alias("chain")))
    return above


def resolve(requests: DataFrame, tree: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(request, id, level) of requests (request, and a column of names for each level).

    The deepest named level that has a node of that name below all nodes' names given above it decides; of several such nodes the first by id.
    A level without a fitting node gives way to the one above it. Requests that fit nowhere have no row. Requests never meet
    single nodes: nodes are folded first by the names they can be asked for, of which a node at depth d has (d + 2) ** d at most.
    """
    wanted = requests.select("request", *(F.coalesce(F.col(x), F.lit("")).alias(x) for x in levels))
    chains = _chains(tree, levels)
    found = None
    for depth, level in enumerate(levels):
        # a row for each way of naming a node: its own name, and for each level above one of the chain's names or none
        given = chains.filter(F.col("level") == level).select("id", F.col("name").alias(level), F.array_distinct(F.concat(F.array(F.lit("")), "chain")).alias("chain"))
        for above in levels[:depth]:
            given = given.select("*", F.explode("chain").alias(above))
        names = list(levels[: depth + 1])
        first = wanted.filter(F.col(level) != "").join(given.groupBy(*names).agg(F.min("id").alias("id")), names).select("request", "id", F.lit(level).alias("level"), F.lit(depth).alias("depth"))
        found = first if found is None else found.unionByName(first)
    best = found.groupBy("request").agg(F.max(F.struct("depth", "id", "level")).alias("b"))
    return best.select("request", "b.id", "b.level")
