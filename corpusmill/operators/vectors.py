"""A stored vector index: coarse cells with exact pruning, and upserts that rewrite the touched cells only.

Centroids are vectors of the table, chosen by the least hash of their ids, so that a
build run again chooses them again. A vector lies in the cell of its nearest centroid
c; a cell knows its radius, the largest distance r of a vector from c. For any query q
the product with a vector of the cell is at most q.c + |q| r, and the part of q that
is along c bounds it again where vectors have unit length (see ``bounds``). A search
reads the cells with the best bounds first, takes the k-th best product found there,
and then reads only those other cells whose bound reaches it: the result is that of a
full scan. How much is pruned depends on the data and is reported by ``share_read``.

Each cell is a folder of a version of its own. An upsert writes the cells that lose or
get a vector, and publishes a version that names the old folders of all others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.published import Version, Writer, current
from .ranking import dot

#: Cells of an index, at most: they are named one by one in a commit.
CELLS = 64
#: What products of doubles may be off by, relative to the vectors' lengths.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _assign(centroids: np.ndarray) -> Callable:
    """Adds each vector's cell (the first of the nearest centroids), distance from it and length."""
    norms = (centroids**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(batch.schema.get_field_index("vector")))
            cell = (norms - 2 * v @ centroids.T).argmin(axis=1)
            away = np.sqrt(((v - centroids[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((v**2).sum(axis=1)))], names=[*batch.schema.names, "cell", "away", "length"])

    return run


def _dealt(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_assign(centroids), f"{kind}, cell int, away double, length double")


def _usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """Vectors in doubles; null ids, and vectors that are null or hold null, are left out."""
    own = rows.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    others = [c for c in rows.columns if c not in (id_, vector)]
    return own.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector"), *others)


def _publish(spark: SparkSession, root: str, rows: DataFrame, centroids: np.ndarray, state: str, parts: dict[str, str], drop: set[int]) -> Version:
    """Write ``rows`` by cell; cells in ``drop`` lose their folders, the others keep them."""
    writer = Writer(spark, root)
    written = writer.write("cells", rows.repartition("cell"), "cell")
    found = written.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.max("length").alias("longest"), F.min("length").alias("shortest")).collect()  # a row a cell
    kept = {k: v for k, v in parts.items() if k.isdigit() and int(k) not in drop}
    made = {str(r["cell"]): json.dumps({"at": writer.version, "n": r["n"], "r": r["r"], "longest": r["longest"], "shortest": r["shortest"]}) for r in found}
    writer.parts = kept | made | {"centroids": json.dumps(centroids.tolist()), "schema": rows.schema.json()}
    return writer.publish(state)


def build(spark: SparkSession, root: str, rows: DataFrame, id_: str, vector: str, state: str = "", cells: int = CELLS) -> VectorIndex:
    """Index ``rows``; other columns are kept. Ids are to be unique; all vectors have one width."""
    own = _usable(rows, id_, vector)
    first = own.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(cells).select("vector").collect()  # CELLS rows at most
    centroids = np.unique(np.array([r[0] for r in first], dtype=np.float64), axis=0) if first else np.zeros((0, 0))
    _publish(spark, root, _dealt(own, centroids), centroids, state, {}, set())
    return VectorIndex(spark, root)


class VectorIndex:
    """An index as it is now; a version that is opened stays as it was."""

    def __init__(self, spark: SparkSession, root: str, version: Version | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = version or current(spark, root)
        if self.version is None:
            raise FileNotFoundError(root)
        self.cells = {int(k): json.loads(v) for k, v in self.version.parts.items() if k.isdigit()}
        self.centroids = np.array(json.loads(self.version.parts["centroids"]), dtype=np.float64)

    def read(self, cells: list[int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.version.parts["schema"]))
        bare = StructType([f for f in schema if f.name != "cell"])
        if not cells:
            return self.spark.createDataFrame([], bare)
        return self.spark.read.schema(bare).parquet(*(f"{self.root}/{self.cells[c]['at']}/cells/cell={c}" for c in cells))

    def rows(self) -> DataFrame:
        return self.read(sorted(self.cells)).drop("away", "length")

    def bounds(self, query: list[float]) -> dict[int, float]:
        """For each cell a number that no product of the query with one of its vectors exceeds.

        With b the share of q along c: a vector v of length L at distance r from c has v.c >= (L^2 + |c|^2 - r^2) / 2, so for lengths from s to l
        the part of v across c is at most sqrt(l^2 - (v.c / |c|)^2), and q.v <= b v.c / |c| + |across part of q| times that.
        """
        q = np.array(query, dtype=np.float64)
        length, out = float(np.sqrt(q @ q)), {}
        for c, known in self.cells.items():
            own = self.centroids[c]
            size, radius, longest, shortest = float(np.sqrt(own @ own)), known["r"], known["longest"], known["shortest"]
            best = float(q @ own) + length * radius
            best = min(best, length * longest)
            if size > 0:
                along = float(q @ own) / size
                across = math.sqrt(max(0.0, length**2 - along**2))
                least = (shortest**2 + size**2 - radius**2) / (2 * size)  # of v along c
                if least > 0:
                    # the product is largest where v points most like q within the cone of the cell
                    near = along / length if length else 0.0
                    cone = min(1.0, least / longest) if longest else 1.0
                    if near < cone:  # q lies outside the cone
                        most = along * cone + across * math.sqrt(max(0.0, 1 - cone**2))
                        best = min(best, most * (longest if most > 0 else shortest))
            out[c] = best + SLACK * (1 + length * max(longest, size))
        return out

    def search(self, query: list[float], k: int, first: int = 4) -> DataFrame:
        """The k rows with the largest products (rounded to 6 places; ties: smaller id), as a full scan would find them."""
        bounds = self.bounds(query)
        order = sorted(bounds, key=lambda c: (-bounds[c], c))
        q = F.array(*(F.lit(float(x)) for x in query))
        scored = lambda cells: self.read(cells).drop("away", "length").withColumn("score", F.round(dot(F.col("vector"), q), 6))
        least = lambda cells: [r[0] for r in scored(cells).select("score").orderBy(F.desc("score")).limit(k).collect()]  # noqa: E731  k numbers at most
        some = order[:first]
        known = least(some)
        floor = known[-1] - 1e-6 if len(known) == k else -math.inf
        self.looked_at = some + [c for c in order[first:] if bounds[c] >= floor]
        return scored(self.looked_at).orderBy(F.desc("score"), "id").limit(k)

    def share_read(self) -> float:
        """Of the last search: vectors in the cells that it read, of all vectors."""
        return sum(self.cells[c]["n"] for c in self.looked_at) / max(1, sum(x["n"] for x in self.cells.values()))

    def upsert(self, rows: DataFrame, id_: str, vector: str, state: str | None = None) -> VectorIndex:
        """The index with ``rows`` put in the place of those of their ids (of rows with one id the last by all columns). Cells that keep their vectors are not read but for ids, and not written."""
        own = _usable(rows, id_, vector)
        own = own.groupBy("id").agg(F.max(F.struct(*[c for c in own.columns if c != "id"])).alias("r")).select("id", "r.*").select(own.columns)
        new = _dealt(own, self.centroids)
        ids = new.select("id")
        kept = {c: self.read([c]).select("id") for c in self.cells}
        where = None
        for c, held in kept.items():
            part = held.withColumn("cell", F.lit(c))
            where = part if where is None else where.unionByName(part)
        touched = {r[0] for r in new.select("cell").distinct().collect()}  # cells
        if where is not None:
            touched |= {r[0] for r in where.join(ids, "id", "left_semi").select("cell").distinct().collect()}
        old = [c for c in touched if c in self.cells]
        stay = _dealt(self.read(old).drop("away", "length").join(ids, "id", "left_anti").select(own.columns), self.centroids)
        version = _publish(self.spark, self.root, stay.unionByName(new), self.centroids, self.version.state if state is None else state, self.version.parts, touched)
        return VectorIndex(self.spark, self.root, version)
