"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label and length are dealt into tiles of about TILE_BYTES, and the
grid of tile pairs into squares of up to SQUARE by SQUARE tiles. A task holds the
tiles of a square's one side and streams those of the other past them; so by one
shuffle a tile travels once for every SQUARE tiles of its label, in the precision
of its input (4 bytes a component of array<float>, which is exact). Labels of fewer
tiles have smaller squares, which keeps tasks many. A
vector x of length 1 is s*q + e with whole q in [-127, 127]; so the cosine of x
and y is at most s_x*s_y*(q_x.q_y) + |e_x| + (1 + |e_x|)*|e_y|. A tile product of
the q gives that bound for all pairs of two tiles: 32-bit floats are exact for
EXACT components (127 * 127 * 1,040 is below 2^24), of which longer vectors are
summed in whole numbers. Only pairs whose bound reaches the threshold are computed
again in double precision. A tile product gives each vector's links as a sum and a
spanning forest, never all its linked pairs.

Equal vectors of one label are one class, with its number of copies. Vectors that
are null, empty or zero, that hold null or non-finite components, or whose label
is null link with nothing; vectors of different lengths do not link. Rows that
share a vec_id are one node, whatever their vectors and labels are: what one of
them reaches, all reach. n_links is of each row: the other rows linked to its
vector. A null vec_id links with nothing; its component is null and it is not
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components, forest
from ._memory import mapped
from ._store import materialise, table

THRESHOLD = 0.98
#: Bytes of a tile's vectors: the larger, the less is shuffled; a task holds two tiles.
TILE_BYTES = 4 << 20
#: Tiles of a square's side at most, and tiles of a label for each tile of a side.
SQUARE, TILES_FOR_ONE = 8, 16
#: Components whose int8 products sum exactly in 32-bit floats.
EXACT = 1_024
_ROWS = 256


def _profile(width: int) -> Callable:
    """vec_id, label, and for valid vectors their fingerprint and components as floats of ``width`` bytes."""
    kind = np.dtype(f"<f{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, labels = batch.columns
            raws, prints = [], []
            for i, v, label in zip(ids, vectors, labels):
                x = None
                if i.is_valid and v.is_valid and label.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raws.append(None if x is None else x.tobytes())
                prints.append(None if x is None else hashlib.blake2b(raws[-1] + str(label.as_py()).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(prints, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "print", "raw"])

    return run


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (rows) as int8, their scales, and bounds of the lengths of what is lost."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """One row: the ids, copies and vectors of a tile."""
    raw = b"".join(x.as_py() for x in rows.column("raw"))
    return pa.table({"label": [key[0].as_py()], "size": [key[1].as_py()], "tile": [key[2].as_py()], "tiles": [rows.column("tiles")[0].as_py()], "ids": [rows.column("rep").to_numpy().astype(np.int64).tobytes()], "copies": [rows.column("copies").to_numpy().astype(np.int64).tobytes()], "raw": [raw]}, schema=_TILES)


_TILES = pa.schema([("label", pa.int64()), ("size", pa.int64()), ("tile", pa.int64()), ("tiles", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary())])


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of unit vectors x and y, by blocks of rows of x; in one tile (``same``) each pair once."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    right = qy.T.astype(np.float32)
    cuts = range(0, x.shape[1], EXACT)
    for at in range(0, len(x), _ROWS):
        to = min(at + _ROWS, len(x))
        own = qx[at:to].astype(np.float32)
        product = own @ right if len(cuts) == 1 else sum((own[:, c : c + EXACT] @ right[c : c + EXACT]).astype(np.float64) for c in cuts)
        bound = product.astype(np.float64) * sx[at:to, None] * sy + ex[at:to, None] + (1 + ex[at:to, None]) * ey
        i, j = np.nonzero(bound >= threshold - 1e-6)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 14):
            a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            keep = np.einsum("nd,nd->n", x[a], y[b]) >= threshold
            if keep.any():
                yield a[keep], b[keep]


def _unit(raw: bytes, kind: np.dtype, size: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float, width: int) -> Callable:
    """Reads tiles sorted by square, those of the held side first: gives (u, u, links of u) and a spanning forest of the links as (u, v, 0)."""
    kind = np.dtype(f"<f{width}")

    def linked(one: tuple, other: tuple, same: bool) -> pa.RecordBatch | None:
        (ids1, copies1, raw1, size), (ids2, copies2, raw2, _) = one, other
        x = _unit(raw1, kind, size)
        y = x if same else _unit(raw2, kind, size)
        counts, counts2, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a, b in tile_links(x, y, same, threshold):
            np.add.at(counts, a, copies2[b])
            np.add.at(counts2, b, copies1[a])
            edges = forest(np.concatenate([edges[0], ids1[a]]), np.concatenate([edges[1], ids2[b]]))
        on, on2 = counts > 0, counts2 > 0
        u = np.concatenate([ids1[on], ids2[on2], edges[0]])
        n = np.concatenate([counts[on], counts2[on2], np.zeros(len(edges[0]), np.int64)])
        v = np.concatenate([ids1[on], ids2[on2], edges[1]])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                label, size, i, j, side, ids, copies, raw = (batch.column(k)[row] for k in range(batch.num_columns))
                own = np.frombuffer(ids.as_buffer(), np.int64).copy(), np.frombuffer(copies.as_buffer(), np.int64).copy(), raw.as_buffer().to_pybytes(), size.as_py()
                if (label, size, i, j) != key:
                    key, held = (label, size, i, j), []
                if i == j:  # each pair of the square's tiles once, and each tile with itself
                    held.append(own)
                found = (linked(one, own, one is own) for one in held) if i == j or side.as_py() else ()
                yield from (x for x in found if x is not None)
                if i != j and not side.as_py():
                    held.append(own)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept. One row for each row of ``vectors``."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    width, kind = (4, "array<float>") if kind == "array<float>" else (8, "array<double>")
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("bigint").alias("label"))
    profile = own.mapInArrow(_profile(width), "vec_id bigint, label bigint, print binary, raw binary")
    classes = materialise(profile.filter("print is not null").groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("raw").alias("raw")).withColumn("size", (F.length("raw") / width).cast("bigint")), "classes")
    sizes = classes.groupBy("label", "size").agg(F.ceil(F.count("*") * F.col("size") * width / tile_bytes).cast("bigint").alias("tiles"))
    dealt = classes.join(sizes, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")))
    tiles = materialise(dealt.groupBy("label", "size", "tile").applyInArrow(_tile, "label bigint, size bigint, tile bigint, tiles bigint, ids binary, copies binary, raw binary"), "tiles")
    pairs = _squares(tiles)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(parts, "label", "size", "i", "j").sortWithinPartitions("label", "size", "i", "j", "side")
    found = materialise(mapped(pairs, _compare(threshold, width), "u bigint, v bigint, n bigint"), "links")
    members = materialise(own.mapInArrow(_profile(width), "vec_id bigint, label bigint, print binary, raw binary").select("vec_id", "print"), "members")
    groups = components(found.filter("u <> v").select("u", "v").union(_same_ids(members, classes)))
    counts = found.filter("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    of = classes.join(counts, "rep", "left").join(groups, F.col("rep") == groups["node"], "left").select("print", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = materialise(members.join(of, "print", "left").select("vec_id", "n_links", "component_id"), "rows")
    nodes = rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("component_id").alias("own"))  # rows of an id that link with nothing go with its others
    whole = rows.join(nodes, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("own", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _squares(tiles: DataFrame) -> DataFrame:
    """Each tile once for each square of its label's grid that it has a side in; the held side is 0."""
    wide = F.greatest(F.lit(1), F.least(F.lit(SQUARE), F.floor(F.col("tiles") / TILES_FOR_ONE))).cast("bigint")
    own = tiles.withColumn("wide", wide).withColumn("at", F.floor(F.col("tile") / F.col("wide")).cast("bigint")).withColumn("last", F.floor((F.col("tiles") - 1) / F.col("wide")).cast("bigint"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    return sent.select("label", "size", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).cast("int").alias("side"), "ids", "copies", "raw")


def _same_ids(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes that rows of one vec_id belong to."""
    places = members.filter("print IS NOT NULL").join(classes.select("print", "rep"), "print").select("vec_id", "rep")
    ends = places.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("vec_id", "low")
    return places.join(ends, "vec_id").filter("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM v WHERE n > 0 AND isfinite(n)),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.n * b.n) >= 0.98),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.c)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = e.vec_id
"""
