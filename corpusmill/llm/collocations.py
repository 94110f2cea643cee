"""Phrase collocation mining: sketch bounds, delimiter-guarded automata, sums, thresholds.

First pass: every run of 1 to MAX_WORDS words within a piece is hashed, with its
language, to a cell; there are about as many cells as a quarter of the text's bytes,
within CELLS, so that a cell holds few phrases whatever the size. Tasks send the cells of a few megabytes of text
as sorted arrays, one for each slab of cells, and each slab is summed. A cell's sum
is an upper bound of the count of each phrase in it, so a phrase that occurs LEAST
times is in a cell of at least that sum. These cells are a bitmap of bounded size
(a bit for each, 16 to 128 MB), which goes through the driver to every task.

Second pass: a shard is some megabytes of text of one language. Its phrases in
heavy cells, of which all parts are in heavy cells too, are candidates. They become automata with a space before and after
each phrase as a guard, of at most PATTERN_BYTES each; the shard's text, words
with one space between and a line feed between pieces, is run through them, and
overlapping matches are counted. Counts are summed over shards, then the exact
threshold applies: bounds that are too high only cost time. A shard knows only its
own candidates, so work grows with the text and not with text times vocabulary.

Scores and containment are joins of the frequent phrases with themselves; numbers
are decimals of 38 digits, and quotients are exact.

A null text is empty, a null language is ``und``. Repeated rows count each time. An
empty table gives an empty result; other columns, doc_id too, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import grams, mix, word_hashes
from ._memory import mapped
from ._store import materialise, table

LEAST, MAX_WORDS, TOP = 10, 3, 2000
#: Percent of a candidate's count from which a longer candidate that contains it makes it go.
INSIDE = 50
#: log2 of the least and the greatest number of cells, and of cells in a slab.
CELLS, SLAB = (27, 30), 19
#: Bytes of text that a task holds before the language with most of it is handled, and of patterns in one automaton.
HELD, PATTERN_BYTES = 6 << 20, 3 << 20
_U = np.uint64
#: A-Z become a-z, tabs spaces, and what ends a piece a line feed.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))


def canonical(texts: list[bytes]) -> bytes:
    """Lower-cased words with one space before and after each, and a line feed between pieces."""
    flat = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    return b" ".join([b"", *filter(None, flat.split(b" ")), b""])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Languages and canonical texts of about HELD bytes, or what there is at the end."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_buffer().to_pybytes()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            total += len(text)
            while total >= HELD:
                most = max(sizes, key=sizes.get)
                total -= sizes.pop(most)
                yield most, canonical(held.pop(most))
    for lang, texts in held.items():
        yield lang, canonical(texts)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and piece of each word."""
    raw = np.frombuffer(text, dtype=np.uint8)
    black = (raw != 32) & (raw != 10)
    edge = np.flatnonzero(np.diff(black.view(np.int8)))  # the text begins and ends with a space
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    pieces = np.searchsorted(np.flatnonzero(raw == 10), starts)
    return word_hashes(raw, starts, ends, lower=False), starts, ends, pieces


def _phrases(lang: str, hashes: np.ndarray, pieces: np.ndarray, most: int, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the first words of all phrases, and their cells."""
    salt = mix(np.array([int.from_bytes(lang.encode()[-8:], "little") + len(lang) * 0x9E3779B97F4A7C15 & (2**64 - 1)], dtype=np.uint64))
    for k in range(1, most + 1):
        at = np.flatnonzero(pieces[: len(pieces) - k + 1] == pieces[k - 1 :]) if len(pieces) >= k else np.zeros(0, np.int64)
        if len(at):
            yield k, at, (mix(grams(hashes, k)[at] ^ salt) >> _U(64 - cells)).astype(np.uint32)


def _sketch(least: int, most: int, cells: int, salts: int) -> Callable:
    """Rows: slab, part of it, cells that occur once in a shard, cells that occur more often, and how often (up to ``least``)."""
    slab_bits = min(SLAB, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _shards(batches):
            hashes, _, _, pieces = _words(text)
            found = [c for _, _, c in _phrases(lang, hashes, pieces, most, cells)]
            if not found:
                continue
            own = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            own, counts = own[first], np.diff(np.append(first, len(own)))
            cuts = np.searchsorted(own, np.arange(0, (1 << (cells - slab_bits)) + 1, dtype=np.uint64) << _U(slab_bits))
            salt = zlib.crc32(text) % salts
            rows: list[tuple[int, int, bytes, bytes, bytes]] = []
            for slab in np.flatnonzero(np.diff(cuts)).tolist():
                part, n = own[cuts[slab] : cuts[slab + 1]] & np.uint32((1 << slab_bits) - 1), counts[cuts[slab] : cuts[slab + 1]]
                often = n > 1
                rows.append((slab, salt, part[~often].tobytes(), part[often].tobytes(), np.minimum(n[often], least).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["slab", "salt", "once", "often", "n"])

    return run


def _summed(least: int, cells: int, last: bool) -> Callable:
    """Rows sorted by slab and part become sums (up to ``least``) of each part's cells that are not 0, or, at ``last``, the bitmap of each slab's cells that reach ``least``."""
    width = 1 << min(SLAB, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(width, dtype=np.int64)

        def made() -> pa.RecordBatch:
            if last:
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["slab", "bits"])
            some = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([some.astype(np.uint32).tobytes()], pa.binary()), pa.array([np.minimum(sums[some], least).astype(np.uint32).tobytes()], pa.binary())], names=["slab", "salt", "once", "often", "n"])

        for batch in batches:
            for slab, salt, once, often, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (slab, salt) != key:
                    if key is not None:
                        yield made()
                    key = slab, salt
                    sums[:] = 0
                sums[np.frombuffer(once, dtype=np.uint32)] += 1
                sums[np.frombuffer(often, dtype=np.uint32)] += np.frombuffer(n, dtype=np.uint32)
        if key is not None:
            yield made()

    return run


def _groups(patterns: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for p in patterns:
        group.append(p)
        size += len(p)
        if size >= PATTERN_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def matches(text: str, patterns: list[str]) -> np.ndarray:
    """How often each pattern occurs in ``text``, overlapping ones included."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(patterns):
        automaton.add_word(p, i)
    automaton.make_automaton()
    return np.bincount(np.fromiter((i for _, i in automaton.iter(text)), dtype=np.int64), minlength=len(patterns))


def _heavy(phrases: Iterator[tuple[int, np.ndarray, np.ndarray]], bits: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the first words of the phrases in heavy cells; a phrase is not more frequent than its beginning and its end, so both have to be in heavy cells."""
    shorter = np.ones(n + 1, dtype=bool)
    for k, at, cell in phrases:
        at = at[((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1) & shorter[at] & shorter[at + (k > 1)]]
        shorter = np.zeros(n + 1, dtype=bool)
        shorter[at] = True
        yield k, at


def _scan(bitmap: object, most: int, cells: int) -> Callable:
    """Rows: language, phrase, number of words and count in a shard; a null phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        for lang, text in _shards(batches):
            hashes, starts, ends, pieces = _words(text)
            chars = text.decode("latin-1")  # a character for each byte
            yield _counted(lang, [None], [0], [len(starts)])
            found: set[str] = set()
            for k, at in _heavy(_phrases(lang, hashes, pieces, most, cells), bits, len(starts)):
                found.update(chars[a:b] for a, b in zip((starts[at] - 1).tolist(), (ends[at + k - 1] + 1).tolist()))
            for group in _groups(sorted(found)):
                counts = matches(chars, group)
                yield _counted(lang, [p[1:-1].encode("latin-1") for p in group], [p.count(" ") - 1 for p in group], counts)

    return run


def _counted(lang: str, phrases: list, lengths: list, counts: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "n"])


def cells_for(size: int) -> int:
    """log2 of the number of cells for a text of so many bytes; about 0.4 phrases of up to three words begin at a byte."""
    return min(max((size // 4).bit_length() - 1, CELLS[0]), CELLS[1])


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MAX_WORDS, cells: int | None = None) -> DataFrame:
    """lang, phrase, words, n of every phrase of up to ``most`` words that occurs ``least`` times; a null phrase counts all words of a language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells or cells_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    salts = max(1, parts >> max(0, cells - SLAB))
    kind = "slab int, salt int, once binary, often binary, n binary"
    dealt = lambda df: df.repartition(parts, "slab", "salt").sortWithinPartitions("slab", "salt")
    sketch = dealt(mapped(docs, _sketch(least, most, cells, salts), kind))
    if salts > 1:
        sketch = dealt(mapped(sketch, _summed(least, cells, False), kind))
    bitmap = bytearray(1 << (cells - 3))
    width = 1 << (min(SLAB, cells) - 3)
    # an iterator runs a partition at a time, so slabs are summed, in all tasks at once, before it
    for row in materialise(mapped(sketch, _summed(least, cells, True), "slab int, bits binary"), "cells").toLocalIterator():
        bitmap[row["slab"] * width : (row["slab"] + 1) * width] = row["bits"]
    known = spark.sparkContext.broadcast(bytes(bitmap))
    del bitmap
    found = mapped(docs, _scan(known, most, cells), "lang string, phrase string, words int, n bigint")
    return materialise(found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull()), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``most`` words."""
    counts = phrase_counts(docs, least, most, cells)
    totals = counts.filter("phrase is null").select("lang", F.col("n").alias("n"))
    known = counts.filter("phrase is not null")
    phrases = known.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))))")
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    # of each phrase, the count of the most frequent longer candidate around it
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: joined(i, m))))
    around = phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * inside))
    rows = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM w),
h AS (SELECT lang, 1 AS k, w[i] AS x FROM g UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM g WHERE i < len(w)
      UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM g WHERE i + 1 < len(w)),
c AS (SELECT lang, k, x, count(*)::BIGINT AS f FROM h GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, k, x, f AS a, string_split(x, ' ') AS w FROM c WHERE k >= 2 AND f >= 10),
cut AS (SELECT lang, k, x, a, 1 AS j, w[1] AS le, array_to_string(w[2:], ' ') AS ri FROM q UNION ALL SELECT lang, k, x, a, 2, w[1] || ' ' || w[2], w[3] FROM q WHERE k = 3),
s AS (SELECT cut.lang, cut.x, cut.a, j, cl.f AS l, cr.f AS r, ((1000000::HUGEINT * a * a) // (cl.f::HUGEINT * cr.f))::BIGINT AS score
      FROM cut JOIN c cl ON cl.lang = cut.lang AND cl.x = le JOIN c cr ON cr.lang = cut.lang AND cr.x = ri),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1),
big AS (SELECT lang, y, max(a) AS m FROM (SELECT lang, a, w[1] || ' ' || w[2] AS y FROM q WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM q WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN big ON big.lang = b.lang AND big.y = b.x WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, x AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x)::BIGINT AS rank FROM z) JOIN t USING (lang) WHERE rank <= 2000
"""
