"""Connected components of a graph too large for one machine: alternating large and small stars.

Each round is two grouped minima and joins; the edges of a round are a written
table in the shared folder. Hubs are split by adaptive skew joins. Once the edges
left are few by count, one task of bounded memory joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise


#: Up to so many edges (16 bytes each, and about ten times that while they are joined) are left to one task.
FEW = 500_000


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for all nodes but the smallest of each component."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(src)], at[len(src) :]
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            u, v = forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of the graph: (node, smallest node reachable) of every node."""
    whole = list(batches)
    if whole:
        u, v = forest(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in whole]) for i in (0, 1)))
        tops = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(u, tops), pa.int64()), pa.array(np.append(v, tops), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v, both bigint, not null); component is its smallest node."""
    now = materialise(edges.select("u", "v").filter("u <> v").mapInArrow(_reduce, "u bigint, v bigint").distinct(), tag)
    seen = None
    while True:
        if now.count() <= FEW:
            return now.repartition(1).mapInArrow(_join, "node bigint, component bigint")
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        now = materialise(small, tag)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
