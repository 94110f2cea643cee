"""Graphs of citations: node-link files, neighbourhoods by hop with a cut by degree, and the view of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import materialise
from .blocks import Products, Shared, best

NODE_LINK = "nodes array<map<string,string>>, links array<map<string,string>>"


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON files: id and attributes of each node, source, target and attributes of each link; an edge that several files have comes once."""
    held = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(NODE_LINK).json(path)
    nodes = held.select(F.explode("nodes").alias("n")).select(F.col("n")["id"].alias("id"), F.col("n").alias("attributes")).filter("id IS NOT NULL").dropDuplicates(["id"])
    links = held.select(F.explode("links").alias("l")).select(F.col("l")["source"].alias("source"), F.col("l")["target"].alias("target"), F.col("l").alias("attributes"))
    return nodes, links.filter("source IS NOT NULL AND target IS NOT NULL").dropDuplicates(["source", "target"])


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph as node-link JSON files: each task writes the parts of it that it has, which together are the graph (``read_node_link`` reads the folder)."""
    own = lambda df, *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names)))
    none = F.array().cast("array<map<string,string>>")
    a = nodes.select(F.array(own(nodes, "id")).alias("nodes"), none.alias("links"))
    b = edges.select(none.alias("nodes"), F.array(own(edges, "source", "target")).alias("links"))
    packed = a.union(b).groupBy(F.spark_partition_id().alias("p")).agg(F.flatten(F.collect_list("nodes")).alias("nodes"), F.flatten(F.collect_list("links")).alias("links"))
    packed.select("nodes", "links").repartition("nodes").write.option("maxRecordsPerFile", 1).json(path)


def neighbourhood(asked: DataFrame, edges: DataFrame, hops: int, degree: int, order: Column | None = None) -> DataFrame:
    """(asked, node, hop): the nodes within ``hops`` steps of each asked node (column ``asked``), at their first hop, which is from 1 on.

    ``edges``: source, target, both ways if they are to be. From each node at most ``degree`` edges are followed: those first by
    ``order`` (default: the target), which Spark cuts before it shuffles. So a node reaches at most degree ** hops others, whatever hubs there are.
    """
    rank = F.row_number().over(Window.partitionBy("source").orderBy(order if order is not None else F.asc("target"), F.asc("target")))
    cut = edges.select("source", "target").distinct().withColumn("rank", rank) if order is None else edges.withColumn("rank", rank)
    cut = cut.filter(F.col("rank") <= degree).select("source", "target")
    seen = asked.select("asked", F.col("asked").alias("node"), F.lit(0).alias("hop")).distinct()
    last = seen
    for h in range(1, hops + 1):
        step = last.join(cut, F.col("node") == F.col("source")).select("asked", F.col("target").alias("node")).distinct()
        last = step.join(seen.select("asked", "node"), ["asked", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(last)
    return seen.filter("hop > 0")


def related(asked: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(asked, node, shared, rank): other sources that share a target with an asked one, those with most shared targets first, then by id.

    The asked ones' targets are compared with all others' block by block: pairs are not made, however many sources share a target.
    """
    sets = materialise(links.filter("source IS NOT NULL").groupBy("source").agg(F.collect_set("target").alias("value")), "targets")
    own = sets.join(asked.select(F.col("asked").alias("source")), "source", "left_semi").select(F.col("source").alias("asked"), "value", F.lit(1).alias("times"))
    found = best(own, sets.withColumnRenamed("source", "node"), limit + 1, Shared).filter("asked <> node")  # one of them may be itself
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("at"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit).select("asked", "node", F.col("score").cast("bigint").alias("shared"), "rank")


def similar(asked: DataFrame, vectors: DataFrame, limit: int, shown: DataFrame | None = None, recall: int = 4) -> DataFrame:
    """(asked, node, score, rank): of the ``recall`` rows of ``vectors`` (node, vector) with the largest product, those that are not the asked one and not in ``shown`` (asked, node); ``limit`` at most.

    The asked rows (asked, vector) are a stated set that is compared with all rows, block by block.
    """
    kind = vectors.schema["vector"].dataType.simpleString()
    kind = kind if kind == asked.schema["vector"].dataType.simpleString() else "array<double>"
    own = asked.select("asked", F.col("vector").cast(kind).alias("value")).groupBy("asked", "value").agg(F.count("*").alias("times"))
    found = best(own, vectors.select("node", F.col("vector").cast(kind).alias("value")), recall, Products).filter("asked <> node")
    if shown is not None:
        found = found.join(shown.select("asked", "node"), ["asked", "node"], "left_anti")
    first = Window.partitionBy("asked").orderBy("at")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).select("asked", "node", "score", "rank")
