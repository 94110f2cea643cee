"""Byte-level BPE encoding and decoding by recursive DuckDB queries within each partition.

The distinct words of a batch become token-position rows, one for each byte. A
recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of minimum rank until no pair is left; words at their
fixpoint leave the recursion. Decoding joins ids with the vocabulary and
aggregates their bytes in order, once for each distinct word; a document's bytes
are those of its words in order, as its ids are. Texts are cut by the tokenizer's pattern; the
results of words met before are kept in a worker up to a fixed number and then
dropped, which changes speed only. Words above LONG bytes, for which contraction
by whole rounds takes quadratic time, go through the same merges with a heap.

A null text is empty and has no ids. Special tokens are not known. Repeated rows
give repeated results, an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import KEEPERS, mapped
from ._store import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries kept by a worker, bytes of text handled at a time, and the length from which a word is long.
KEPT, PART, LONG = 900_000, 4 << 20, 1 << 11
#: Bytes of open words, and words, of one recursive query. DuckDB writes no files: what a query needs fits its memory.
ROUND_BYTES, ROUND_WORDS = 1 << 19, 30_000

ENCODE = """
WITH RECURSIVE state(k, tok, done) AS (  -- k: the word's number times 4096, plus the token's position
  SELECT k, tok, false FROM bytes_of
  UNION ALL
  (WITH open_ AS (SELECT k, tok FROM state WHERE NOT done),
        least_ AS (SELECT a.k >> 12 AS w, min((m.rank::BIGINT << 12) | (a.k & 4095)) AS best
                   FROM open_ a LEFT JOIN (SELECT k - 1 AS k, tok FROM open_) b ON b.k = a.k
                   LEFT JOIN merges m ON m.pair = ((a.tok::BIGINT << 20) | b.tok) GROUP BY 1)
   SELECT CASE WHEN (o.k & 4095) > (best & 4095) THEN o.k - 1 ELSE o.k END,
          CASE WHEN (o.k & 4095) = (best & 4095) THEN (best >> 12)::INT ELSE o.tok END,
          best IS NULL
   FROM open_ o JOIN least_ ON (o.k >> 12) = least_.w
   WHERE best IS NULL OR (o.k & 4095) <> (best & 4095) + 1)
)
SELECT k, tok FROM state WHERE done
"""
DECODE = """
SELECT i.w, string_agg(v.bytes, '' ORDER BY i.pos) AS bytes
FROM ids i JOIN vocabulary v ON v.id = i.tok GROUP BY i.w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Coder:
    """Encodes and decodes words; ``pattern`` cuts texts into words."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        #: Only of this pattern it is known where words begin and that letters alone are one word.
        self.known_pattern = pattern == public_tokenizers.PATTERN
        left, right, rank = [], [], []
        for token, value in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(value)
        merges = pa.table({"pair": np.array(left, np.int64) << 20 | np.array(right, np.int64), "rank": np.array(rank, np.int32)})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [x.decode("latin-1") for x in self.ranks]})  # a character for each byte
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.register("given", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.kept: dict[str, bytes] = {}
        #: What a word's ids decode to, where that isn't the word's own bytes.
        self.other: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has. A word that is in the vocabulary is one token."""
        given = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        whole, long_ = given >= 0, (given < 0) & (sizes > LONG)
        keys, ids = [np.flatnonzero(whole) << 12], [given[whole].astype(np.int32)]
        open_ = np.flatnonzero(~whole & ~long_ & (sizes > 0))
        at, through = 0, np.cumsum(sizes[open_])
        while at < len(open_):
            before = through[at] - sizes[open_[at]]
            to = min(at + ROUND_WORDS, max(at + 1, int(np.searchsorted(through, before + ROUND_BYTES, side="right"))))
            some = open_[at:to]
            at = to
            lengths = sizes[some]
            raw = np.frombuffer(b"".join([words[i] for i in some]), dtype=np.uint8)
            place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.db.register("bytes_of", pa.table({"k": np.repeat(some << 12, lengths) + place, "tok": self.byte[raw]}))
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("bytes_of")
            keys.append(found.column("k").to_numpy())
            ids.append(found.column("tok").to_numpy())
        key, tok = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        word, tok = key[order] >> 12, tok[order]
        counts = np.bincount(word, minlength=len(words))
        if long_.any():
            heads = np.cumsum(counts) - counts
            found = {int(i): self._heap(words[i]) for i in np.flatnonzero(long_)}
            tok = np.insert(tok, np.repeat([heads[i] for i in found], [len(x) for x in found.values()]), np.concatenate(list(found.values())))
            counts[list(found)] = [len(x) for x in found.values()]
        return tok, counts

    def _heap(self, word: bytes) -> np.ndarray:
        text = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(r, i, 2) for i in range(len(text) - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            if text[i] is None or (j := after[i]) >= len(text) or self.ranks.get(text[i] + text[j]) != rank or len(text[i]) + len(text[j]) != size:
                continue
            text[i], text[j] = text[i] + text[j], None
            after[i] = after[j]
            if after[i] < len(text):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(text) and (r := self.ranks.get(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (r, a, len(text[a]) + len(text[b])))
        return np.array([self.ranks[x] for x in text if x is not None], dtype=np.int32)

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each of several sequences of ids, given one after another."""
        out = [b""] * len(counts)
        if len(ids):
            self.db.register("ids", pa.table({"w": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "pos": np.arange(len(ids), dtype=np.int32), "tok": ids}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for w, text in zip(found.column("w").to_pylist(), found.column("bytes").to_pylist()):
                out[w] = text.encode("latin-1")
        return out

    #: A space with white space before or after it.
    _NEAR = re.compile(r" \s|\s ")

    def segments(self, text: str) -> list[str]:
        """Cuts the text before each space where every word boundary of the pattern falls: between two characters that are no white space."""
        if not self.known_pattern:
            return [text]
        if self._NEAR.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def forget(self) -> None:
        self.kept, self.other = {}, {}

    def code(self, texts: Iterable[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        cut = [self.segments(x) if x else [] for x in texts]
        parts, words = {}, set()
        for x in set().union(*cut):
            bare = x[1:] if x[0] == " " else x
            if self.known_pattern and bare.isalpha():  # one word of the pattern
                words.add(x)
            else:
                parts[x] = self.pattern.findall(x)
                words.update(parts[x])
        fresh = list(words.difference(self.kept))
        if len(self.kept) + len(fresh) > KEPT:
            self.forget()
            fresh = list(words)
        raw = [w.encode() for w in fresh]
        ids, counts = self.encode_words(raw)
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
        self.kept.update(zip(fresh, [flat[a:b] for a, b in zip([0, *ends], ends)]))
        self.other.update((w, d) for w, r, d in zip(fresh, raw, self.decode_ids(ids, counts)) if d != r)
        kept, other = self.kept, self.other
        for x, p in parts.items():
            parts[x] = b"".join([kept[w] for w in p])
            if other and any(w in other for w in p):
                other[x] = b"".join([other.get(w, w.encode()) for w in p])
        look = {w: kept[w] for w in words} | parts
        return [(b"".join(map(look.__getitem__, x)), b"".join([other.get(w) or w.encode() for w in x]) if other else "".join(x).encode()) for x in cut]


_coders: dict[tuple[str, str], Coder] = {}
KEEPERS[__name__] = _coders.clear


def coder(path: str, pattern: str) -> Coder:
    """One coder a worker process: it outlives a task, until the worker serves another operator."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        held.append(x or "")
        size += len(held[-1])
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def _code(name: str, pattern: str, path: str | None, whole: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or public_tokenizers.path(name), pattern)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1).to_pylist()):
                gc.disable()  # a scan of all that is kept would find nothing
                try:
                    found = own.code(texts)
                finally:
                    gc.enable()
                columns = [batch.column(0).slice(at, len(texts)), pa.array([len(a) // 4 for a, _ in found], pa.int64())]
                if whole:
                    columns += [pa.array([np.frombuffer(a, dtype="<u4").astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([b.decode("utf-8") for _, b in found], pa.string())]
                else:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x, _ in found], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for _, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "a", "b"])
                at += len(texts)

    return run


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_decode(docs: DataFrame, name: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (string). ``path``: a rank file that all executors can read; else ``name`` is looked up there."""
    return mapped(_inputs(docs), _code(name, pattern, path, True), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, name: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes. One pass, no shuffle."""
    return mapped(_inputs(docs), _code(name, pattern, path, False), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
