"""Token counts of a public tokenizer, by pieces of distinct pre-tokens.

Tokenizers never merge across pre-tokens, so a text has as many tokens as the sum
over its pre-tokens of their pieces. One pass collects the distinct pre-tokens of
the corpus (each task sends those that it has seen once, up to a number of bytes),
with the number of blocks of text that sent them; pieces are counted once for each
by the library. A second pass gives each document's pre-token frequencies. Those
pre-tokens that most blocks have are looked up by a broadcast join, as many as
BROADCAST_BYTES hold; what a document has besides, few and rare, by a join that
shuffles. Ids are never listed.

The pre-token pattern is applied by ``regex`` where that cuts as the library does:
byte-level tokenizers without a normalizer, and texts without characters that are
unassigned in this Python's Unicode tables, whose classes differ by version. Other
texts and tokenizers go through the library's own normalizer and pre-tokenizer.
Added tokens, special ones too, are cut out first, as the library does by default.

A null text is empty and has no tokens; null doc_ids keep their rows. Rows that
share a doc_id stay apart, equal rows are repeated. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import KEEPERS, mapped
from ._store import materialise, table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Pre-tokens that are broadcast take so many bytes at most, with ROW for each besides its own.
BROADCAST_BYTES, ROW = 8 << 20, 32
#: Bytes of text of a block; a task forgets which pre-tokens it has sent after so many bytes of them.
BLOCK, SENT_BYTES = 4 << 20, 16 << 20


#: Beyond these, characters are looked at one by one.
_BASIC = 0xFFFF
_beyond = re.compile("[\U00010000-\U0010ffff]").findall


@cache
def _unassigned() -> re.Pattern:
    """Basic characters whose class may have changed since."""
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in range(_BASIC + 1) if unicodedata.category(chr(c)) == "Cn") + "]")


def may_differ(text: str) -> bool:
    """Whether a character of the text is unassigned in this Python's tables."""
    return bool(_unassigned().search(text)) or any(unicodedata.category(c) == "Cn" for c in set(_beyond(text)))


class Cutter:
    """Cuts texts into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        added = known["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError("added tokens with conditions are not known here")
        self.added = {x["content"] for x in added}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        before = known["pre_tokenizer"] or {}
        self.plain = not known["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def _cut(self, text: str) -> Counter:
        if not text:
            return Counter()
        if self.plain and (text.isascii() or not may_differ(text)):
            return Counter(self.find(text))
        given = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        cut = self.library.pre_tokenizer.pre_tokenize_str(given)
        return Counter([given[a:b] for _, (a, b) in cut] if self.plain else [x for x, _ in cut])

    def frequencies(self, text: str) -> Counter:
        if not self.marks.search(text):
            return self._cut(text)
        found, at = Counter(), 0
        for m in self.marks.finditer(text):
            found.update(self._cut(text[at : m.start()]))
            found[m[0]] += 1
            at = m.end()
        found.update(self._cut(text[at:]))
        return found

    def pieces(self, given: list[str]) -> list[int]:
        if self.plain:
            return [len(x.ids) for x in self.library.encode_batch_fast(given, add_special_tokens=False)]
        model = self.library.model
        return [1 if x in self.added else len(model.tokenize(x)) for x in given]


_cutters: dict[str, Cutter] = {}
KEEPERS[__name__] = _cutters.clear


def cutter(path: str) -> Cutter:
    if path not in _cutters:
        _cutters[path] = Cutter(path)
    return _cutters[path]


def _distinct(name: str, path: str | None) -> Callable:
    """Pre-tokens of blocks of text, each with the number of blocks of this task that had it since it was sent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path or public_tokenizers.path(name))
        seen: Counter = Counter()
        block: set[str] = set()
        size = held = 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "blocks"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                block.update(own.frequencies(text).keys())
                size += len(text)
                if size >= BLOCK:
                    held += sum(len(x) for x in block if x not in seen)
                    seen.update(block)
                    block, size = set(), 0
                    if held >= SENT_BYTES:
                        yield sent()
                        seen, held = Counter(), 0
        seen.update(block)
        yield sent()

    return run


def _pieces(name: str, path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path or public_tokenizers.path(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.pieces(batch.column(0).to_pylist()), pa.int64())], names=["piece", "blocks", "pieces"])

    return run


def _frequencies(name: str, path: str | None) -> Callable:
    """For each row its key, bytes, and pre-tokens with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path or public_tokenizers.path(name))
        for batch in batches:
            found = [own.frequencies(x) for x in batch.column(1).to_pylist()]
            offsets = pa.array([0, *_sums(map(len, found))], pa.int32())
            pieces = pa.ListArray.from_arrays(offsets, pa.array([x for f in found for x in f], pa.string()))
            counts = pa.ListArray.from_arrays(offsets, pa.array([n for f in found for n in f.values()], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pieces, counts], names=["doc_id", "h", "n_bytes", "piece", "n"])

    return run


def _sums(values: Iterator[int]) -> Iterator[int]:
    total = 0
    for v in values:
        total += v
        yield total


def vocabulary(docs: DataFrame, name: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """piece, blocks, pieces: each distinct pre-token of ``text``, in how many blocks it is (about), and its pieces."""
    found = mapped(_inputs(docs), _distinct(name, path), "piece string, blocks bigint").groupBy("piece").agg(F.sum("blocks").alias("blocks"))
    return mapped(found, _pieces(name, path), "piece string, blocks bigint, pieces bigint")


def _inputs(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``path``: a tokenizer file that all executors can read; else ``name`` is looked up there."""
    known = materialise(vocabulary(docs, name, path), "pretokens")
    # from how many blocks (a power of two) a pre-token is common: all that are common fit BROADCAST_BYTES
    sizes = dict(known.groupBy(F.floor(F.log2("blocks")).cast("int").alias("p")).agg(F.sum(F.octet_length("piece") + ROW).alias("size")).collect())
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > BROADCAST_BYTES:
            break
        least = p
    is_common = F.floor(F.log2("blocks")) >= least
    common = F.broadcast(known.filter(is_common).select("piece", "pieces"))
    rows = mapped(_inputs(docs), _frequencies(name, path), "doc_id bigint, h bigint, n_bytes bigint, piece array<string>, n array<int>")
    key = ["doc_id", "h", "n_bytes"]
    each = rows.select(*key, F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("piece"), F.lit(1).alias("n"))), F.arrays_zip("piece", "n"))).alias("e")).select(*key, "e.piece", F.col("e.n").cast("bigint").alias("n"))
    met = each.join(common, "piece", "left")
    # a row's common pre-tokens become one number; a null pre-token counts the rows of one key
    rest = F.when(F.col("pieces").isNull(), F.col("piece"))
    part = met.groupBy(*key, rest.alias("piece")).agg(F.sum(F.when(F.col("piece").isNull(), 1).otherwise(0)).alias("times"), F.sum(F.when(rest.isNull(), F.coalesce("pieces", F.lit(0)) * F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("n"))
    part = materialise(part, "frequencies")
    rare = part.filter("piece is not null").join(known.filter(~is_common).select("piece", "pieces"), "piece").groupBy(*key).agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    whole = part.filter("piece is null").alias("a").join(rare.alias("b"), same, "left").select("a.doc_id", "a.n_bytes", "a.times", ((F.col("known") + F.coalesce("rare", F.lit(0))) / F.col("times")).cast("bigint").alias("n_tokens"))
    # equal rows have been summed; give each back
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
