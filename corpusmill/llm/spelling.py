"""Spelling variant grouping by rolling-hash deletions.

Words are the maximal runs of Latin letters of all texts, lower-cased in A-Z only;
a run whose crc32 with its document's id is divisible by DAMAGE loses one letter.
Words of LETTERS or more letters that occur twice or more are compared: two are
near if one inserted, deleted or replaced letter makes them equal.

Letters have 64-bit values. From prefix and suffix polynomials of a block of words
of equal length, the hash of each word without its i-th letter is one NumPy
product and sum. Such a key, with the word and i, and the key of each whole word
are dealt by the key's leading bits (radix), sorted by key within a partition and
read as a stream. Rows with one key are grouped by the letters that are left, so
that a collision joins nothing; a group holds at most one whole word and its
extensions by one letter, whatever the corpus. Longer words of a group are near
to its whole word, and words that lack a letter at the same place are near to each
other; each near pair shares exactly one such group. Counts and the most frequent
near word come from the group's two most frequent members for each place, so
pairs are never listed.

A word's form is its most frequent near word (ties: the first in code-point order)
if that occurs FACTOR times as often; its root is where forms lead. Each step
multiplies the count by FACTOR, so pointer doubling ends after a few rounds.

Null texts have no words; a null doc_id stands as an empty text before the colon.
Repeated rows count each time. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix
from ._memory import mapped
from ._store import materialise, table

LETTERS, LEAST, FACTOR, DAMAGE = 7, 2, 10, 31
#: Leading bits of a key by which rows are dealt.
RADIX = 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """word, n: partial counts are made before the shuffle."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _SMALL), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % letters), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.withColumn("h", h).select(F.when(F.col("h") % damage == 0, left).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: which word, which letter is left out (-1: none), and the key of what is left."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    which, places, keys = [], [], []
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le"), dtype=np.uint32).reshape(len(own), size)
        values = mix(letters.astype(np.uint64) + _U(0xD1B54A32D192ED03))
        power = np.cumprod(np.append(_U(1), np.full(size, _BASE, dtype=np.uint64)), dtype=np.uint64)
        prefix = np.zeros((len(own), size + 1), dtype=np.uint64)  # of the first i letters
        suffix = np.zeros((len(own), size + 1), dtype=np.uint64)  # of the letters from i on
        for i in range(size):
            prefix[:, i + 1] = prefix[:, i] * _U(_BASE) + values[:, i]
            suffix[:, size - 1 - i] = suffix[:, size - i] + values[:, size - 1 - i] * power[i]
        without = prefix[:, :size] * power[size - 1 - np.arange(size)] + suffix[:, 1:]
        which += [own, np.repeat(own, size)]
        places += [np.full(len(own), -1), np.tile(np.arange(size), len(own))]
        keys += [mix(prefix[:, size]), mix(without.ravel())]
    if not which:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    return np.concatenate(which), np.concatenate(places), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            which, places, keys = deletion_keys(part.column(0).to_pylist())
            which = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(which), part.column(1).take(which), pa.array(places, pa.int32())], names=["key", "word", "n", "place"])


def near_in_group(members: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Of words that are equal without the letter at a place (-1: as they are), given with count and place: word, number of near words in this group, count of the most frequent, and it."""
    whole = next(((w, n) for w, n, place in members if place < 0), None)
    longer: dict[str, int] = {}
    at: dict[int, list[tuple[int, str]]] = {}
    for w, n, place in members:
        if place >= 0:
            longer[w] = n
            at.setdefault(place, []).append((-n, w))
    if whole and longer:
        n, w = min((-n, w) for w, n in longer.items())
        yield whole[0], len(longer), -n, w
        for w in longer:
            yield w, 1, whole[1], whole[0]
    for alike in at.values():
        if len(alike) > 1:
            alike.sort()
            for i, (_, w) in enumerate(alike):
                n, other = alike[1 if i == 0 else 0]
                yield w, len(alike) - 1, -n, other


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; a group may go on in the next batch."""
    key, group = None, []

    def closed() -> list[tuple]:
        if len(group) < 2:
            return []
        left: dict[str, list] = {}
        for w, n, place in group:
            left.setdefault(w if place < 0 else w[:place] + w[place + 1 :], []).append((w, n, place))
        return [row for members in left.values() if len(members) > 1 for row in near_in_group(members)]

    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(cuts[1:], len(keys))
        used = (ends - cuts > 1) | (cuts == 0) | (ends == len(keys))  # others are alone with their key
        words, counts, places = (batch.column(i) for i in (1, 2, 3))
        out: list[tuple] = []
        for a, b in zip(cuts[used].tolist(), ends[used].tolist()):
            if keys[a] != key:
                out += closed()
                key, group = keys[a], []
            group += zip(words.slice(a, b - a).to_pylist(), counts.slice(a, b - a).to_pylist(), places.slice(a, b - a).to_pylist())
        yield _rows(out)
    yield _rows(closed())


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame, radix: int = RADIX) -> DataFrame:
    """word, n_near, best_n, best: of each word (word, n) with near words their number and the most frequent."""
    keys = mapped(words.select("word", "n"), _keys, "key bigint, word string, n bigint, place int")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, F.shiftrightunsigned("key", 64 - radix)).sortWithinPartitions("key")
    found = mapped(dealt, _near, "word string, near bigint, best_n bigint, best string")
    order = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(order).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, factor: int = FACTOR, damage: int = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = materialise(vocabulary(docs, letters, least, damage), "words")
    near = near_words(words)
    formed = F.col("best_n") >= F.col("n") * factor
    rows = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log(most, factor)) + 1))):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialise(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32; its table follows from the polynomial, and a text's bytes are folded over it.
SQL = r"""
WITH RECURSIVE poly(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS m FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, m, xor(list_reduce(list_transform(range(length(hex(encode(id || ':' || run))) // 2), lambda j: ('0x' || substr(hex(encode(id || ':' || run)), (2 * j + 1)::INT, 2))::BIGINT),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM u, tab),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
d AS (SELECT DISTINCT word, n, k FROM k),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.k UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.k),
b AS (SELECT word, count(*)::BIGINT AS n_near, max(m) AS m, min(other) FILTER (WHERE m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM p) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
w(word, spot) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.spot WHERE f.form IS NOT NULL),
last AS (SELECT w.word, w.spot FROM w JOIN f ON f.word = w.spot WHERE f.form IS NULL)
SELECT f.word, form, coalesce(last.spot, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last USING (word)
"""
