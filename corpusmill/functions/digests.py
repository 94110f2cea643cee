"""The first four bytes of MD5 digests of all pairs of a beginning and an end, many at once."""

from __future__ import annotations

import math
import struct

import numpy as np

_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """The padded messages' words, each for all pairs, for all heads (1, n) or for all tails (n, 1)."""
    own, length = heads.shape[1], heads.shape[1] + tails.shape[1]
    begins = np.zeros((len(heads), (own + 3) // 4 * 4), dtype=np.uint8)
    begins[:, :own] = heads
    ends = np.zeros((len(tails), ((length + 8) // 64 + 1) * 64), dtype=np.uint8)
    ends[:, own:length], ends[:, length] = tails, 0x80
    ends[:, -8:] = np.frombuffer(struct.pack("<Q", length * 8), dtype=np.uint8)
    begins, ends = np.ascontiguousarray(begins.view("<u4").T), ends.view("<u4")
    return [begins[i][None] if i < own // 4 else begins[i][None] | ends[:, i : i + 1] if i < len(begins) else ends[:, i : i + 1] for i in range(ends.shape[1])]


def md5_heads(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Of each tail (row) and head (column) the digest's first four bytes as a number; ``heads`` and ``tails`` are bytes, a text in each row."""
    words, shape = _words(heads, tails), (len(tails), len(heads))
    state = [np.full(shape, x, dtype=np.uint32) for x in _START]
    f = np.empty(shape, dtype=np.uint32)
    for block in range(0, len(words), 16):
        last = block + 16 == len(words)
        a, b, c, d = (x.copy() for x in state)
        for i in range(61 if last else 64):  # the last three steps are not of the first bytes
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            np.add(f, words[block + g] + _SINES[i], out=f)
            np.left_shift(f, np.uint32(_TURNS[i]), out=a)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
            np.bitwise_or(a, f, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            return (state[0] + b).byteswap()
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    raise AssertionError("a message has at least one block")
