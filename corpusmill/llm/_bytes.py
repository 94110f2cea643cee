"""Vectorised word hashing over the raw UTF-8 buffers of Arrow string columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. Those bytes
never occur inside a multi-byte character, so this equals splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 18
_rng = np.random.default_rng(0x5EED)
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``limit`` bytes of column ``text``, or one row: rows, text bytes, row offsets."""
    column = batch.column(batch.schema.get_field_index("text"))
    if pa.types.is_large_string(column.type):
        column, width = column, np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), raw[own[0] : own[-1]], own - own[0]
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one entry more than rows)."""
    black = ~_SPACE[raw]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = black[:-1]
    edge = offsets[:-1]
    before[edge[edge < len(raw)]] = False
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = black[1:]
    edge = offsets[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``lower``: A-Z count as a-z."""
    table, n = _LOWER if lower else _PLAIN, len(starts)
    out = np.empty(n, dtype=np.uint64)
    at = 0
    while at < n:
        base = starts[at]
        to = int(np.searchsorted(ends, base + _PIECE, "right"))
        if to <= at:  # one word longer than a piece
            text = raw[base : ends[at]].tobytes()
            out[at] = int.from_bytes(hashlib.blake2b(text.lower() if lower else text, digest_size=8).digest(), "little")
            at += 1
            continue
        part = raw[base : ends[to - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(table[part] * _POW[: len(part)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        at = to
    return out


_TURN = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` (up to 64) consecutive hashes, also those that cross rows."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _TURN[k]
    return mix(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one."""
    starts, ends, first = words(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True)
    all_grams = grams(hashes, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            own = np.sort(all_grams[a : b - n + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(mix(np.array([sum(int(h) * int(t) for h, t in zip(hashes[a:b], _TURN)) + int(b - a) & (2**64 - 1)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
