"""The k best of all rows for each of many asked rows, compared block by block.

Asked rows are dealt into blocks of about BLOCK and the others into groups of about
GROUP; a square is a block and a group. Its task holds the block and streams the
group past it, HELD asked rows against up to SLICE others at a time, and keeps k rows
for each asked one. So a task's memory is bounded, an asked row gives k rows for each
group and not one for each row, and all pairs are looked at. A row of the group comes in
order of its node; after k others a later one has to be better than the k-th, not
as good. Slices grow from FIRST on, so that few pairs are looked at before that is known.

How two rows are compared is a class: ``read`` of a column of values, and ``against``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..store import materialise

#: Asked rows of a block and other rows of a group, about; asked rows compared at once; rows of a slice at first and at most.
BLOCK, GROUP, HELD, FIRST, SLICE = 4_096, 65_536, 256, 64, 8_192
#: Numbers that a step makes at once, about.
AT_ONCE = 1 << 22
#: A group has at least so many rows before the table is cut for the sake of the cores.
LEAST = 1_024


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists' lengths, and the row of each of their members."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.repeat(np.arange(len(n)), n)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero; what overflows stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * 1e6
        whole = np.trunc(y)
        out = (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 1e6
    return np.where(np.isfinite(out), out, x)


class Products:
    """Inner products in doubles, added from the first component on and rounded to 6 places. Components that are null or that one side lacks are left out; without any there is no product.

    A matrix product finds the pairs that may be good enough, with room for its error; those are added up in order.
    """

    @staticmethod
    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Components, which of them are there (None: all), and which rows a matrix product can't tell about."""
        n, row = _lengths(column)
        flat, width = column.flatten(), int(n.max(initial=0))
        if not flat.null_count and (n == width).all():
            x, there = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), width), None
        else:
            x, there = np.zeros((len(n), width)), np.zeros((len(n), width), bool)
            known, at = flat.is_valid().to_numpy(zero_copy_only=False), _spans(np.zeros(len(n), np.int64), n)
            x[row[known], at[known]] = flat.drop_null().to_numpy(zero_copy_only=False)
            there[row[known], at[known]] = True
        return x, there, ~(np.abs(x) <= 1e100).all(axis=1)

    @staticmethod
    def against(own: tuple, other: tuple, floor: np.ndarray, unfilled: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(i, j, score, without a score) of pairs that may be over ``floor`` of i; of those without a score the first k, and only where i is ``unfilled``."""
        (x, there, wild), (y, there2, wild2) = own, other
        width = min(x.shape[1], y.shape[1])
        x, y = x[:, :width], y[:, :width]
        part = lambda m, v: np.ones(v.shape, np.float32) if m is None else m[:, :width].astype(np.float32)
        none = part(there, x) @ part(there2, y).T == 0 if there is not None or there2 is not None or not width else None
        a, b = (np.where(w[:, None], 0.0, v) if w.any() else v for w, v in ((wild, x), (wild2, y)))
        about = a @ b.T
        error = 1e-13 * (width + 1) * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max(initial=0.0)
        about[wild], about[:, wild2] = np.inf, np.inf
        if none is not None:
            about[none] = np.nan
        i, j = np.nonzero(about >= (floor + 0.4e-6 - error)[:, None])  # a rounded product over the floor is 0.5e-6 over it before
        score = np.zeros(len(i))
        step = max(1, AT_ONCE // max(1, width))
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            with np.errstate(over="ignore", invalid="ignore"):
                terms = x[p] * y[q]
                for m, r in ((there, p), (there2, q)):
                    if m is not None:
                        terms[~m[r, :width]] = 0.0
                score[at : at + step] = np.cumsum(terms, axis=1)[:, -1]
        score, without = rounded(score), np.zeros(len(i), bool)
        if none is not None and unfilled.any():
            none &= unfilled[:, None]
            i2, j2 = np.nonzero(none & (np.cumsum(none, axis=1) <= k))
            i, j, score, without = np.concatenate([i, i2]), np.concatenate([j, j2]), np.concatenate([score, np.full(len(i2), np.nan)]), np.concatenate([without, np.ones(len(i2), bool)])
        return i, j, score, without


class Shared:
    """Members that two sets share; pairs that share none are left out."""

    @staticmethod
    def read(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
        """The different members, and of each member of a set its place among them and its row."""
        _, row = _lengths(column)
        flat = column.flatten().dictionary_encode()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        return flat.dictionary, flat.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), row[known], len(column)

    @staticmethod
    def against(own: tuple, other: tuple, floor: np.ndarray, unfilled: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        (words, code, row, size), (words2, code2, row2, size2) = own, other
        rows, n = row[np.argsort(code, kind="stable")], np.bincount(code, minlength=len(words))
        start = np.cumsum(n) - n
        place = pc.index_in(words2, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code2]
        met, row2 = place[place >= 0], row2[place >= 0]
        ends = np.cumsum(n[met])
        total = int(ends[-1]) if len(ends) else 0
        sparse = total * 16 < size * size2
        cells = np.zeros(0 if sparse else size * size2, np.int64)
        cuts = [0, *np.searchsorted(ends, np.arange(AT_ONCE, total, AT_ONCE), "right"), len(met)]
        for at, to in zip(cuts, cuts[1:]):
            some = n[met[at:to]]
            pairs = rows[_spans(start[met[at:to]], some)] * size2 + np.repeat(row2[at:to], some)
            if sparse:
                cells = np.concatenate([cells, pairs])
            else:
                cells += np.bincount(pairs, minlength=size * size2)
        least = np.maximum(floor, 0)
        if sparse:
            at, count = np.unique(cells, return_counts=True)
            good = count > least[at // size2]
            at, count = at[good], count[good]
        else:
            at = np.flatnonzero(cells.reshape(size, size2) > least[:, None])
            count = cells[at]
        return at // size2, at % size2, count.astype(np.float64), np.zeros(len(at), bool)


class _Held:
    """Up to HELD asked rows and the k best that each has met."""

    def __init__(self, how: type, rows: pa.RecordBatch, k: int):
        self.how, self.rows, self.k, self.own = how, rows, k, how.read(rows.column("value"))
        self.row, self.score, self.without, self.node = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), None

    def meet(self, other: tuple, node: pa.Array) -> None:
        n = np.bincount(self.row, minlength=self.rows.num_rows)
        full, last = n >= self.k, np.cumsum(n) - 1
        at, floor = last[full], np.full(len(n), -np.inf)
        floor[full] = np.where(self.without[at], -np.inf, np.where(np.isnan(self.score[at]), np.inf, self.score[at]))  # nothing is before not-a-number, and all are before none
        i, j, score, without = self.how.against(self.own, other, floor, ~full, self.k)
        if not len(i):
            return
        row, score, without = np.concatenate([self.row, i]), np.concatenate([self.score, score]), np.concatenate([self.without, without])
        node = node.take(pa.array(j))
        node = node if self.node is None else pa.concat_arrays([self.node, node])
        odd = np.isnan(score)
        order = np.lexsort((np.where(odd, 0.0, -score), np.where(without, 2, ~odd), row))  # stable: else as they came
        row = row[order]
        new = np.diff(row, prepend=-1) != 0
        at = np.arange(len(row))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < self.k
        order = order[keep]
        self.row, self.score, self.without, self.node = row[keep], score[order], without[order], node.take(pa.array(order))

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.node is not None:
            own = self.rows.select(["asked", "times"]).take(pa.array(self.row))
            yield pa.RecordBatch.from_arrays([*own.columns, self.node, pa.array(self.score), pa.array(self.without)], names=["asked", "times", "node", "score", "without"])


def _squares(how: type, k: int) -> Callable:
    """Reads squares one after another, of each the asked rows (side 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, own, held, seen = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at_square, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("square", "side"))
            cuts = [0, *np.flatnonzero(np.diff(at_square * 2 + side)) + 1, batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at_square[at] != square:
                    for h in held:
                        yield from h.best()
                    square, own, held, seen = at_square[at], [], [], 0
                if not side[at]:
                    own.append(batch.slice(at, to - at))
                    continue
                if own:
                    block = pa.Table.from_batches(own).combine_chunks().to_batches()
                    held, own = [_Held(how, b.slice(x, HELD), k) for b in block for x in range(0, b.num_rows, HELD)], []
                while held and at < to:
                    some = batch.slice(at, min(to - at, SLICE, max(FIRST, seen)))
                    value, node = how.read(some.column("value")), some.column("node")
                    for h in held:
                        h.meet(value, node)
                    at, seen = at + some.num_rows, seen + some.num_rows
        for h in held:
            yield from h.best()

    return run


def best(asked: DataFrame, rows: DataFrame, k: int, how: type) -> DataFrame:
    """(asked, node, score, at): for each id ``asked`` the k best rows by ``how``: largest score, then least node; at: from 1 on.

    ``asked`` has asked, value and times (how often the row is asked with: so often each of its nodes counts); ``rows`` has node and value, of the same type.
    A pair without a score comes after all others, one whose score is not a number before them.
    """
    spark = rows.sparkSession
    own = materialise(asked.select("asked", "value", F.col("times").cast("int").alias("times")), "asked")
    blocks = max(1, -(-own.count() // BLOCK))
    n = rows.count()
    groups = max(1, -(-n // GROUP), min(-(-n // LEAST), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("asked", "value"), F.lit(blocks))).withColumn("group", every(groups))
    met = rows.select("node", "value").withColumn("group", F.pmod(F.xxhash64("node", "value"), F.lit(groups))).withColumn("block", every(blocks))
    square = (F.col("block") * groups + F.col("group")).alias("square")
    sides = dealt.select(square, F.lit(0).alias("side"), "asked", "times", none("node", rows), "value").unionByName(met.select(square, F.lit(1).alias("side"), none("asked", own), none("times", own), "node", "value"))
    sorted_ = sides.repartitionById(blocks * groups, F.col("square").cast("int")).sortWithinPartitions("square", "side", F.asc_nulls_last("node"))
    schema = StructType([own.schema["asked"], own.schema["times"], rows.schema["node"], StructField("score", DoubleType()), StructField("without", BooleanType())])
    found = sorted_.mapInArrow(_squares(how, k), schema).withColumn("score", F.when(~F.col("without"), F.col("score")))
    counted = found.withColumn("time", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    first = Window.partitionBy("asked").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("node"))
    return counted.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k).select("asked", "node", "score", "at")
