"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its own seed. The vector of a letter trigram is
the product (binding) of its letters' vectors, permuted by 2, 1 and 0 steps; a
text's vector is the sum (bundle) of its trigrams' vectors, a language's
prototype the sum over all its training texts. A text gets the language whose
prototype has the largest cosine. Letters are lower-cased; whatever lies between
words is one gap symbol. Sums are whole numbers, so the result does not depend on
how rows are partitioned.

The prediction is `und` with score 0 where the text is null, empty or has no
letter, and where nothing could be learned. Ties go to the smaller language name.
Null languages teach nothing. Texts of any length are read whole. Repeated rows
give repeated results, an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import slices
from ._memory import mapped
from ._store import table

DIMENSIONS = 2048
#: Trigrams bundled at once, which bounds a task's memory.
PART = 512
#: Letters whose vectors a worker keeps, DIMENSIONS bytes each; beyond, all are drawn again.
LETTERS = 16_384
BITS = 21
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


_MASK = (1 << BITS) - 1
#: Bits of a trigram's code that are set where one of its letters is 128 or more.
_BEYOND = (_MASK & ~127) * (1 | 1 << BITS | 1 << 2 * BITS)
#: Codes of a-z and the gap, whose pairs have a table: 1 to 26 and 0.
_PLAIN = np.full(128, 0, dtype=np.int64)
_PLAIN[97:123] = np.arange(1, 27)


@cache
def symbols() -> np.ndarray:
    """For each code point its lower case if it is a letter, or 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x32400):  # no letters beyond
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


_letters: dict[int, np.ndarray] = {}


def letter(point: int) -> np.ndarray:
    """The vector of a letter (0: the gap), from the letter's own seed."""
    if point not in _letters:
        if len(_letters) >= LETTERS:
            _letters.clear()
        _letters[point] = (np.random.default_rng([1009, point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _letters[point]


@cache
def pairs() -> tuple[np.ndarray, np.ndarray]:
    """The products of the first two letters of a trigram, a row for each pair of a-z and the gap; and the vectors of the third."""
    base = np.stack([letter(p) for p in (0, *range(97, 123))])
    return (np.roll(base, 2, axis=1)[:, None] * np.roll(base, 1, axis=1)).reshape(27 * 27, DIMENSIONS), base


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the product of their letters' vectors permuted by 2, 1 and 0 steps."""
    a, b, c = codes >> 2 * BITS, codes >> BITS & _MASK, codes & _MASK
    if int(max(a.max(), b.max(), c.max())) < 128:
        two, base = pairs()
        return two[_PLAIN[a] * 27 + _PLAIN[b]] * base[_PLAIN[c]]
    points, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    base = np.stack([letter(int(p)) for p in points])
    x, y, z = at.reshape(3, -1)
    return np.roll(base, 2, axis=1)[x] * np.roll(base, 1, axis=1)[y] * base[z]


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct trigram codes and their counts; none where it has no letter."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    edges = heads[offsets]
    found, codes = [], symbols()[points]
    for a, b in zip(edges[:-1], edges[1:]):
        own = codes[a:b]
        keep = own > 0
        if not keep.any():
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        keep[1:] |= own[:-1] > 0
        own = own[keep].astype(np.int64)
        own = np.concatenate([[0], own, [0] if own[-1] else []]).astype(np.int64)
        found.append(np.unique(own[:-2] << 2 * BITS | own[1:-1] << BITS | own[2:], return_counts=True))
    return found


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(DIMENSIONS, dtype=np.float64)
    other = (codes & _BEYOND) != 0
    for part in (~other, other):
        own, n = codes[part], counts[part].astype(np.float32)
        for at in range(0, len(own), PART):
            total += n[at : at + PART] @ bound(own[at : at + PART]).astype(np.float32)
    return np.rint(total).astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition one row a language: the sum of its texts' vectors."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, raw, offsets in slices(batch):
            by: dict[str, list] = {}
            for lang, found in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), trigrams(raw, offsets)):
                by.setdefault(lang, []).append(found)
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes))
                sums[lang] = sums.get(lang, 0) + bundle(codes, counts)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their unit vectors: DIMENSIONS numbers a language, whatever the corpus size."""
    own = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    parts = mapped(own, _learn, "lang string, sums array<bigint>")
    rows = parts.select("lang", F.posexplode("sums").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("v")).collect()
    known = {r["lang"]: np.array([x["v"] for x in r["v"]], dtype=np.float64) for r in rows}
    known = {k: v / np.linalg.norm(v) for k, v in sorted(known.items()) if v.any()}
    return list(known), np.array(list(known.values())).reshape(len(known), DIMENSIONS)


def _predict(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = model.value
        for batch in batches:
            langs, scores, seen = [], [], []
            for _, raw, offsets in slices(batch):
                for codes, counts in trigrams(raw, offsets):
                    seen.append(len(codes))
                    own = bundle(codes, counts).astype(np.float64) if len(codes) and names else None
                    norm = np.linalg.norm(own) if own is not None else 0
                    if not norm:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = vectors @ own / norm
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(seen, pa.int32())], names=[*batch.schema.names, "r0", "r1", "r2"])

    return run


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Never null: a null doc_id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, known: tuple[list[str], np.ndarray], keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of docs, lang_pred, score and trigrams, the number of different ones, by prototypes ``known``. One pass, no shuffle.

    ``prefix`` goes before the names of the three results, should one of ``keep`` have such a name.
    """
    model = docs.sparkSession.sparkContext.broadcast(known)
    own = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", r0 string, r1 double, r2 int"
    results = (F.col(f"r{i}").alias(prefix + x) for i, x in enumerate(("lang_pred", "score", "trigrams")))
    return mapped(own, _predict(model), schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, prototypes(docs.filter(~held_out(F.col("doc_id")))), ["doc_id"])
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
