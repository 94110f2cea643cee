"""N-gram Jaccard join by PartEnum signatures, and its groups of near-copies.

Sets of shingles are put into size bands such that two sets of the wanted
similarity lie in one band or in neighbouring ones. For each band (instance) the
Hamming distance k of such sets is bounded, so the feature domain is cut into n1
first-level parts of n2 second-level parts each; sets within distance k agree on
n2 - k2 second-level parts of at least z first-level parts. A signature is the
projection of a set on such a choice of parts.

Very frequent shingles (found by a counting sketch of fixed size over all
documents) are left out of the projections: that can only lower the distance, so
no pair is lost. First-level parts of a set where some projection is then empty
are weak. A set with fewer than z weak parts still shares a strong signature
with each partner; a set with more also gives, for the weak parts, projections
with the frequent shingles in. Which shingles count as frequent decides speed
alone, never the result.

Each bucket of equal signatures is read as a sorted stream, never gathered.
Members are compared with leads, links are contracted to components, and only
members of different components of one bucket are then compared with one
another, in pairs of blocks dealt over the tasks. Pairs whose counts of shingles
by part of the feature domain show them too far apart are left; every link is
verified on whole shingle sets.

Nulls, empty texts and texts without words have empty sets and link with
nothing. Equal sets are one class, whose members link. Rows with a null doc_id
are not part of the result; of rows that share a doc_id one class is kept for
each different set, and the component holds them all. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix, shingle_sets, signed, slices
from ._components import components, forest
from ._memory import mapped
from ._store import materialise, table

SHINGLE = 4
PERCENT = 85
#: Counters of the sketch of frequent shingles. A counter of FREQUENT and of FREQUENT_TIMES the mean over all
#: documents is frequent: at most one counter in FREQUENT_TIMES, however large the corpus.
SKETCH = 1 << 24
FREQUENT, FREQUENT_TIMES = 64, 8
#: A side of a join with up to so many ids (8 bytes each) is broadcast; beyond, it is shuffled.
BROADCAST_IDS = 1_000_000
#: Parts of the feature domain whose counts bound the distance of two sets from below; so many are added up for a first look.
CELLS, FOLD = 128, 8
#: Parts whose counts are looked at in sets of FINE_LEAST shingles or more: large sets differ too little in fewer.
FINE, FINE_LEAST = 2048, 1024
#: Members of a bucket are compared in blocks of about so many; candidates are looked at so many at a time.
BLOCK, LOOK = 1024, 1 << 15
#: So many of its least buckets a member carries; a pair is left to the least bucket that both carry.
LEAST, NONE = 16, (1 << 63) - 1
_U = np.uint64


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


class Bands:
    """Size bands and the parameters of their instances for a similarity of ``percent`` in 100."""

    def __init__(self, percent: int):
        self.percent, self.last = percent, [0]

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            self.last.append(low * 100 // self.percent)
        return int(np.searchsorted(self.last, size))

    def params(self, instance: int) -> tuple[int, int, int, int]:
        """n1, n2, k2, z: with distance k at most, n1 - k // (k2 + 1) >= z first-level parts are within k2."""
        self.of(self.last[-1] + 1 if instance >= len(self.last) else 1)
        k = 2 * self.last[instance] * (100 - self.percent) // (100 + self.percent)
        if k < 6:
            n1, n2, k2 = [(1, 1, 0), (1, 3, 1), (1, 5, 2), (1, 6, 3), (2, 5, 2), (2, 5, 2)][k]
        else:
            z = 3 + k // 100
            n1, n2, k2 = k // 2 + z, 3, 1
        return n1, n2, k2, n1 - k // (k2 + 1)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _key(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def signatures(shingles: np.ndarray, frequent: np.ndarray, bands: Bands) -> np.ndarray:
    """The distinct signatures of a set. ``frequent``: whether each shingle is frequent."""
    band, found = bands.of(len(shingles)), []
    value = mix(shingles ^ _U(0xA5A5A5A55A5A5A5A))
    rare = ~frequent
    for instance in (band, band + 1):
        n1, n2, k2, z = bands.params(instance)
        part = mix(shingles + _U(instance))
        cell = ((part >> _U(33)) % _U(n1)).astype(np.int64) * n2 + (part % _U(n2)).astype(np.int64)
        sums, counts = np.zeros((2, n1 * n2), dtype=np.uint64), np.zeros((2, n1 * n2), dtype=np.int64)
        for level, keep in ((0, rare), (1, slice(None))):
            np.add.at(sums[level], cell[keep], value[keep])
            counts[level] = np.bincount(cell[keep], minlength=n1 * n2)
        sums, counts = sums.reshape(2, n1, n2), counts.reshape(2, n1, n2)
        choices = list(combinations(range(n2), n2 - k2))
        picked = np.stack([sums[:, :, c].sum(axis=2, dtype=np.uint64) for c in choices], axis=2)
        empty = np.stack([counts[0][:, c].sum(axis=1) == 0 for c in choices], axis=1)
        salt = mix((np.arange(n1 * len(choices), dtype=np.uint64) + _U(instance << 40)).reshape(n1, len(choices)))
        found.append(mix(picked[0] ^ salt)[~empty])
        if int(empty.any(axis=1).sum()) >= z:
            found.append(mix(picked[1] + salt * _U(3))[empty])
    return np.unique(np.concatenate(found))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part, raw, offsets in slices(batch):
            yield part, shingle_sets(raw, offsets, n)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ _U(0xC0FFEE)) % _U(SKETCH)).astype(np.int64)


def _profile(n: int) -> Callable:
    """doc_id, set size and fingerprint of each row; after the rows of a partition, its counters well over their mean, as rows with a null size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, dtype=np.uint16)
        names = ["doc_id", "n_shingles", "print", "class", "cell"]
        for part, sets in _sets(batches, n):
            prints = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([x and _key(x) for x in prints], pa.int64()), pa.nulls(len(sets), pa.int32())], names=names)
            cells, counts = np.unique(_cell(np.concatenate(sets)), return_counts=True)
            counters[cells] = np.minimum(counters[cells] + counts, 65535)
        high = np.flatnonzero(counters >= 4 + 4 * int(counters.mean()))
        if len(high):
            yield pa.RecordBatch.from_arrays([pa.array(counters[high].astype(np.int64)), pa.nulls(len(high), pa.int64()), pa.nulls(len(high), pa.binary()), pa.nulls(len(high), pa.int64()), pa.array(high.astype(np.int32))], names=names)

    return run


def _sign(n: int, percent: int, frequent: object) -> Callable:
    """(signature, class) of each different set of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        bits = np.frombuffer(frequent.value, dtype=np.uint8)
        out, held = [], 0
        for _, sets in _sets(batches, n):
            for s in sets:
                if len(s) and (print_ := fingerprint(s)) not in seen:
                    seen.add(print_)
                    key = _key(print_)
                    cell = _cell(s)
                    found = signatures(s, (bits[cell >> 3] >> (cell & 7) & 1).astype(bool), bands)
                    out.append((found, np.full(len(found), key, dtype=np.int64)))
                    held += len(found)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], names=["sig", "class"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], names=["sig", "class"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (sig, class) sorted; gives (bucket, class) where a signature has different classes.

    Signatures with the same members are one bucket, named by the members; the first and the
    last signature of a batch, which may cross its edges, are named by themselves.
    """
    edge = None
    for batch in batches:
        sig, cls = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(sig):
            continue
        if edge is not None:
            sig, cls = np.append(edge[0], sig), np.append(edge[1], cls)
        first = np.ones(len(sig), dtype=bool)
        first[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[first], cls[first]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        bucket = np.add.reduceat(mix(cls.view(np.uint64) ^ _U(0x1234567)), starts).view(np.int64).copy()
        bucket[-1] = sig[-1]
        if edge is not None:
            bucket[0] = sig[0]
        edge = sig[-1], cls[-1]
        keep = np.repeat(sizes > 1, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, sizes)[keep]), pa.array(cls[keep])], names=["bucket", "class"])


def _whole(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, n):
            cells, fine = ([np.minimum(np.bincount((mix(s ^ _U(0xBEEF)) % _U(k)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes() if len(s) >= least else b"" for s in sets] for k, least in ((CELLS, 0), (FINE, FINE_LEAST)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(cells, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "shingles", "cells", "fine"])

    return run


def _near(left: Iterable[bytes], right: Iterable[bytes], n: np.ndarray, percent: int, parts: int) -> np.ndarray:
    """Whether two sets' counts by part leave it open that they are close; ``n`` is the sum of their sizes."""
    x, y = (np.frombuffer(b"".join(side), dtype=np.uint8).reshape(-1, parts).astype(np.int16) for side in (left, right))
    return np.abs(x - y).sum(axis=1, dtype=np.int64) * (100 + percent) <= n * (100 - percent)


def _close(percent: int, group: np.ndarray, side: np.ndarray, rep: np.ndarray, n: np.ndarray, c: np.ndarray, bucket: np.ndarray, cells: np.ndarray, least: np.ndarray, fine: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of one group, of both sides where it has two, of different components and not shown too far apart."""
    order = np.lexsort((n, group))
    group, side, rep, n, c, bucket, cells, least, fine = (x[order] for x in (group, side, rep, n, c, bucket, cells, least, fine))
    large = np.array([len(x) > 0 for x in fine], dtype=bool)
    cells = cells.astype(np.int16)
    rough = cells.reshape(len(cells), -1, FOLD).sum(axis=2, dtype=np.int16)
    two = np.zeros(group[-1] + 1, dtype=bool)
    two[group[side == 1]] = True
    after = np.arange(1, len(n) + 1)
    counts = np.searchsorted((group << 40) + n, (group << 40) + n * 100 // percent, side="right") - after
    ends = np.cumsum(counts)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + LOOK, side="right")))
        x = np.repeat(np.arange(at, to), counts[at:to])
        y = np.arange(len(x)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at] - counts[at]), counts[at:to]) + after[x]
        at = to
        keep = (c[x] != c[y]) & ((side[x] != side[y]) | ~two[group[x]])
        x, y = x[keep], y[keep]
        for counted in (rough, cells):
            # the distance is at least the sum over parts of the difference of counts
            apart = np.abs(counted[x] - counted[y]).sum(axis=1, dtype=np.int64)
            keep = apart * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            x, y = x[keep], y[keep]
        keep = np.ones(len(x), dtype=bool)
        both = np.flatnonzero(large[x] & large[y])
        for k in range(0, len(both), 1024):
            own = both[k : k + 1024]
            keep[own] = _near(fine[x[own]], fine[y[own]], n[x[own]] + n[y[own]], percent, FINE)
        x, y = x[keep], y[keep]
        if len(x):
            # both are members of every bucket that both carry, and the least of those gives the pair
            before = (least[x][:, :, None] == least[y][:, None, :]) & (least[x] < bucket[x][:, None])[:, :, None]
            keep = ~before.any(axis=(1, 2))
            x, y = x[keep], y[keep]
        if len(x):
            found = np.unique(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _blocks(percent: int) -> Callable:
    """Reads members sorted by bucket and pair of blocks; holds one such group and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
            now += [now[0], np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint8).reshape(-1, CELLS), np.array(batch.column(8).flatten()).reshape(-1, LEAST), np.array([*batch.column(9).to_pylist(), None], dtype=object)[:-1]]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            new = np.append(False, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))
            group, last = np.cumsum(new), int(np.flatnonzero(new)[-1]) if new.any() else 0
            if last:
                yield from _close(percent, group[:last], *(x[:last] for x in now[3:]))
            held = [x[last:] for x in now]
        if held is not None:
            yield from _close(percent, np.zeros(len(held[0]), dtype=np.int64), *held[3:])

    return run


def _open(percent: int, parts: int = CELLS) -> Callable:
    """The pairs that their counts by part do not show too far apart, and those of which a set has no such counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            counted = np.array([bool(a and b) for a, b in zip(left, right)], dtype=bool)
            near = ~counted
            near[counted] = _near(*([c for c, k in zip(side, counted) if k] for side in (left, right)), n[counted], percent, parts)
            mask = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            keep = []
            for x, y in zip(left, right):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["u", "v"])

    return run


def _apart(pairs: DataFrame, sets: DataFrame, cells: str, run: Callable) -> DataFrame:
    """The pairs without those that ``run`` shows too far apart by column ``cells`` of sets."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("n").alias("n_" + x), F.col(cells).alias("cells_" + x)) for x in "ab")
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b"), run, "a bigint, b bigint")


def _of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that occur in ``pairs``, a written table: only these are shuffled."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return sets.join(small(ids, ids.count()), "doc_id", "left_semi")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the smallest doc_id reachable by links (itself included)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    profile = materialise(mapped(docs, _profile(shingle), "doc_id bigint, n_shingles bigint, print binary, class bigint, cell int"), "profile")
    mean = (profile.agg(F.sum("n_shingles")).first()[0] or 0) / SKETCH
    high = profile.filter("cell is not null").groupBy("cell").agg(F.sum("doc_id").alias("n")).filter(F.col("n") >= max(FREQUENT, FREQUENT_TIMES * mean)).select("cell")
    bits = np.zeros(SKETCH, dtype=bool)
    bits[[r[0] for r in high.toLocalIterator()]] = True  # SKETCH / FREQUENT_TIMES cells at most
    frequent = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    profile = profile.filter("n_shingles is not null").drop("cell")
    classes = materialise(profile.filter("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("class").alias("class")), "classes")

    signs = mapped(docs, _sign(shingle, percent, frequent), "sig bigint, class bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = mapped(signs.repartition(parts, "sig").sortWithinPartitions("sig", "class"), _buckets, "bucket bigint, class bigint").distinct()
    # a class is named by 8 bytes of its fingerprint; should two share them, both are members
    members = materialise(buckets.join(classes, "class").select("bucket", "rep", "n"), "members")

    needed = members.select("rep").distinct()
    texts = docs.join(small(needed, needed.count()), docs["doc_id"] == F.col("rep"), "left_semi")
    sets = materialise(mapped(texts, _whole(shingle), "doc_id bigint, n bigint, shingles binary, cells binary, fine binary"), "sets")

    links = spark.createDataFrame([], "u bigint, v bigint")
    done = spark.createDataFrame([], "a bigint, b bigint")
    group = None
    for step in range(3):
        now = members if group is None else members.join(group, members["rep"] == group["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
        if group is None:
            now = now.withColumn("c", F.col("rep"))
        open_ = now.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by(F.struct("rep", "n", "c"), F.xxhash64("rep", F.lit(step))).alias("lead"), F.count("*").alias("size")).filter("c0 <> c1")
        if step < 2:
            pairs = now.join(open_, "bucket").filter("c <> lead.c").filter(F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent).select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
            pairs = _apart(pairs, sets, "cells", _open(percent))
        else:
            rest = now.join(open_.select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks")), "bucket").join(sets.select(F.col("doc_id").alias("rep"), "cells", "fine"), "rep")
            least = rest.groupBy("rep").agg(F.slice(F.concat(F.array_sort(F.collect_set("bucket")), F.array_repeat(F.lit(NONE), LEAST)), 1, LEAST).alias("least"))
            rest = rest.join(least, "rep")
            rest = rest.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            rest = rest.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("bigint").alias("side"), "rep", "n", "c", "cells", "least", "fine")
            pairs = mapped(rest.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), _blocks(percent), "a bigint, b bigint").distinct()
        pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if step < 2:
                continue
            break
        near = pairs if step == 2 else materialise(_apart(pairs, _of(pairs, sets), "fine", _open(percent, FINE)), "near")
        own = _of(near, sets)
        whole = near.join(own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
        found = materialise(mapped(whole.select("a", "b", "left", "right"), _verify(percent), "u bigint, v bigint"), "links")
        done, links = done.union(pairs), links.union(found)
        group = components(links, "groups")
        group = materialise(group, "group")

    final = classes.select("print", "rep")
    if group is not None:
        final = final.join(group, final["rep"] == group["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    else:
        final = final.select("print", F.col("rep").alias("component_id"))
    return profile.join(final, "print", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


#: The same rows by brute force: documents that share a shingle are compared.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))
                                        WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM s),
e AS (SELECT doc_id, n, hash(unnest(g)) AS x FROM n),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.c)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = n.doc_id
"""
