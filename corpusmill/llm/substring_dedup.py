"""Substring dedup by suffix automata of reference shards.

A window is WINDOW consecutive words of one document; the words of a window that
also starts in a document with a smaller doc_id are removed.

Documents of equal words are one class, kept by its smallest doc_id. From each
window one anchor is taken, its run of ANCHOR words with the least hash, so equal
windows have equal anchors. Only stretches of windows whose anchor occurs in more
than one class are looked at further: a grouped minimum over window hashes names
a place, in the first document, for each window that recurs, and so the shard that
has to know it. A reference shard holds the recurring stretches of many documents,
about SHARD_WORDS words; long documents are spread over several. Its suffix
automaton keeps the earliest doc_id in its states and goes to every task that
holds candidate stretches for it. These are streamed through it, and where the
matching statistic reaches WINDOW in an earlier document, the maximal spans of
words are removed. A shard with many candidate stretches is sent to several tasks
(salts), so that a passage that very many documents share is dealt out.

All shards times all documents would be quadratic work, so a shard is sent only
where it can match. Hashes only choose candidates; what is removed is decided by
equal words and the earliest doc_id in the automaton. Windows are judged on the
input.

Words are runs other than 0x20 and 0x09-0x0D, unchanged. Null and empty texts
have no words. Null doc_ids are passed over. Documents are expected once; rows
that share a doc_id are treated each by itself and keep their number in the
result, but a window that starts in both of them does not count for them. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import grams, mix, signed, slices, word_hashes, words
from ._memory import mapped
from ._store import materialise, table

WINDOW, ANCHOR = 50, 25
#: Words of a reference shard, about; windows of one document whose places are in one such stretch go to one shard.
SHARD_WORDS, STRETCH = 20_000, 5_000
#: Candidate stretches that one task streams through one shard's automaton.
SALT_ROWS = 1_000
#: A list of up to so many ids is broadcast; beyond, it is shuffled.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_NEVER = (1 << 63) - 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of one document the hash of its least run of ``anchor`` words."""
    runs = grams(hashes, anchor)
    return np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1).min(axis=1)


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    return grams(hashes, window)


def _profile(window: int, anchor: int) -> Callable:
    """Each row's digests (with a null anchor), and the distinct anchors of the different word sequences of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "print", "class", "sha", "anchor"]
        seen: set[int] = set()
        for batch in batches:
            for part, raw, offsets in slices(batch):
                starts, ends, first = words(raw, offsets)
                hashes = word_hashes(raw, starts, ends, lower=False)
                n = part.num_rows
                counts, prints, classes, shas, found, own = np.diff(first), [], [], [], [], []
                whole = raw.tobytes()
                for i in range(n):
                    text = b" ".join(whole[offsets[i] : offsets[i + 1]].split())
                    prints.append(hashlib.blake2b(text, digest_size=16).digest())
                    classes.append(int.from_bytes(prints[-1][:8], "little", signed=True))
                    shas.append(hashlib.sha256(text).hexdigest())
                    if counts[i] >= window and classes[-1] not in seen:
                        seen.add(classes[-1])
                        a = np.unique(window_anchors(hashes[first[i] : first[i + 1]], window, anchor))
                        found.append(a)
                        own.append(np.full(len(a), classes[-1], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(prints, pa.binary()), pa.array(classes, pa.int64()), pa.array(shas, pa.string()), pa.nulls(n, pa.int64())], names=names)
                if found:
                    a = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), pa.array(np.concatenate(own)), pa.nulls(len(a), pa.string()), signed(a)], names=names)

    return run


def _regions(window: int, anchor: int) -> Callable:
    """Stretches of words whose windows have one of the row's shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for part, raw, offsets in slices(batch):
                starts, ends, first = words(raw, offsets)
                hashes = word_hashes(raw, starts, ends, lower=False)
                shared = part.column(2)
                for i in range(part.num_rows):
                    a, b = first[i], first[i + 1]
                    if b - a < window:
                        continue
                    hit = np.isin(window_anchors(hashes[a:b], window, anchor), shared[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    for s, e in _runs(hit):
                        text = raw[starts[a + s] : ends[a + e - 1 + window - 1]].tobytes()
                        rows.append((part.column(0)[i].as_py(), int(s), b" ".join(text.split())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], names=["doc_id", "start", "text"])

    return run


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _windows(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, 1 << 20):
                starts, ends, first = words(raw, offsets)
                hashes = grams(word_hashes(raw, starts, ends, lower=False), window)
                rows = np.arange(part.num_rows)
                counts = np.maximum(np.diff(first) - window + 1, 0)
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                ids, begins = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                of = np.repeat(rows, counts)
                yield pa.RecordBatch.from_arrays([signed(hashes[np.repeat(first[:-1], counts) + place]), pa.array(ids[of]), pa.array(begins[of]), pa.array(place.astype(np.int32))], names=["window", "doc_id", "start", "place"])

    return run


def _spans(window: int) -> Callable:
    """From a stretch and the shards of its windows: reference spans (role 0: the document is the first to have them) and candidate spans (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, str]] = []
            for doc, start, text, places, shards, later in zip(*(batch.column(i) for i in range(6))):
                doc, start, tokens = doc.as_py(), start.as_py(), text.as_py().split(" ")
                at, own = (x.values.to_numpy(zero_copy_only=False) for x in (places, shards))
                order = np.argsort(at)
                at, own, role = at[order], own[order], np.array(later.as_py(), dtype=bool)[order]
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0) | (role[1:] != role[:-1])]))
                for s, e in zip(cut, np.append(cut[1:], len(at))):
                    a, b = int(at[s]), int(at[e - 1]) + window
                    out.append((int(own[s]), int(role[s]), doc, start + a, " ".join(tokens[a:b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], pa.string())], names=["shard", "role", "doc_id", "start", "text"])

    return run


class SuffixAutomaton:
    """Of word sequences, added one after another with a separator between them; each state has the earliest document that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.earliest = [-1], [0], [_NEVER]
        self.last, self.marks, self.whole = 0, 0, True

    def add(self, sequence: list[str], doc: int = 0) -> None:
        for token in sequence:
            self._extend(token, doc)
        self.marks += 1
        self._extend(self.marks, doc)  # a whole number equals no word
        self.whole = False

    def _extend(self, token: object, doc: int) -> None:
        next_, link, size = self.next, self.link, self.size
        cur = len(next_)
        next_.append({})
        size.append(size[self.last] + 1)
        link.append(0)
        self.earliest.append(doc)
        p = self.last
        while p >= 0 and token not in next_[p]:
            next_[p][token] = cur
            p = link[p]
        if p >= 0:
            q = next_[p][token]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                self.earliest.append(_NEVER)
                while p >= 0 and next_[p].get(token) == q:
                    next_[p][token] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def _settle(self) -> None:
        """What ends in a state's words ends in those of its suffix link too."""
        link, earliest = self.link, self.earliest
        for state in np.argsort(-np.array(self.size), kind="stable").tolist()[:-1]:
            if earliest[state] < earliest[link[state]]:
                earliest[link[state]] = earliest[state]
        self.whole = True

    def spans(self, sequence: list[str], least: int, doc: int = 1) -> list[tuple[int, int]]:
        """Maximal stretches of ``sequence`` covered by runs of ``least`` tokens that a document before ``doc`` holds."""
        if not self.whole:
            self._settle()
        next_, link, size, earliest = self.next, self.link, self.size, self.earliest
        state = length = 0
        found: list[tuple[int, int]] = []
        for i, token in enumerate(sequence):
            while state and token not in next_[state]:
                state = link[state]
                length = size[state]
            if token in next_[state]:
                state = next_[state][token]
                length += 1
            if length >= least:
                run = state  # the state of the last ``least`` tokens
                while size[link[run]] >= least:
                    run = link[run]
                if earliest[run] < doc:
                    a, b = i + 1 - least, i + 1
                    if found and a <= found[-1][1]:
                        found[-1] = found[-1][0], b
                    else:
                        found.append((a, b))
        return found


def _match(window: int) -> Callable:
    """Reads rows sorted by shard, salt and role: builds each shard's automaton and streams its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for shard, salt, role, doc, start, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != (shard, salt):
                    key, automaton = (shard, salt), SuffixAutomaton()
                if role == 0:
                    automaton.add(text.split(" "), doc)
                else:
                    out += [(doc, start + a, start + b) for a, b in automaton.spans(text.split(" "), window, doc)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["doc_id", "a", "b"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, shas, texts = [], [], [], []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tokens = (text or "").encode().split()
            keep = np.ones(len(tokens), dtype=bool)
            for s in spans:
                keep[s["a"] : s["b"]] = False
            kept = b" ".join([t for t, k in zip(tokens, keep) if k])
            ids.append(doc)
            counts.append(int((~keep).sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_removed", "sha"])


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    all_ = materialise(mapped(docs, _profile(window, anchor), "doc_id bigint, n_words bigint, print binary, class bigint, sha string, anchor bigint"), "anchors")
    profile = all_.filter("anchor is null").select("doc_id", "n_words", "print", "class", "sha")
    classes = materialise(profile.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("class").alias("class")), "classes")
    anchors = all_.filter("anchor is not null").select("class", "anchor")
    shared = anchors.groupBy("anchor").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("anchor")
    touched = materialise(anchors.join(shared, "anchor").join(classes.select("class", "rep"), "class").groupBy("rep").agg(F.collect_set("anchor").alias("anchors")), "touched")

    held = docs.join(_small(touched.select("rep"), touched.count()), docs["doc_id"] == F.col("rep"), "left_semi")
    regions = materialise(mapped(held.join(touched, held["doc_id"] == touched["rep"]).select("doc_id", "text", "anchors"), _regions(window, anchor), "doc_id bigint, start bigint, text string").dropDuplicates(["doc_id", "start"]), "regions")
    windows = mapped(regions, _windows(window), "window bigint, doc_id bigint, start bigint, place int")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", (F.col("start") + F.col("place")).alias("at"))).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    firsts = firsts.select("window", F.col("first.doc_id").alias("first"), F.floor(F.col("first.at") / STRETCH).alias("stretch"))
    firsts = materialise(firsts, "firsts")  # so that the join below has plain exchanges, whose hot windows are split
    shards = max(1, -(-firsts.count() // SHARD_WORDS))
    routed = firsts.select("window", "first", F.pmod(F.xxhash64("first", "stretch"), F.lit(shards)).alias("shard"))
    marked = windows.join(routed, "window").groupBy("doc_id", "start").agg(F.collect_list(F.struct("place", "shard", (F.col("first") < F.col("doc_id")).alias("later"))).alias("m"))
    spans = mapped(regions.join(marked, ["doc_id", "start"]).select("doc_id", "start", "text", F.col("m.place").alias("places"), F.col("m.shard").alias("shards"), F.col("m.later").alias("later")), _spans(window), "shard bigint, role int, doc_id bigint, start bigint, text string")
    spans = materialise(spans, "spans")

    candidates = spans.filter("role = 1")
    salts = candidates.groupBy("shard").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    asked = candidates.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))
    given = spans.filter("role = 0").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = ["shard", "salt", "role", "doc_id", "start", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = given.select(columns).union(asked.select(columns)).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "role")
    cuts = materialise(mapped(dealt, _match(window), "doc_id bigint, a bigint, b bigint").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "cuts")

    hit = docs.join(_small(cuts.select("doc_id"), cuts.count()), "doc_id", "left_semi")
    changed = mapped(hit.join(cuts, "doc_id"), _cut, "doc_id bigint, n_removed bigint, sha string").groupBy("doc_id").agg(F.max_by(F.struct("n_removed", "sha"), "n_removed").alias("c")).select("doc_id", "c.n_removed", F.col("c.sha").alias("cut_sha"))
    nothing = hashlib.sha256(b"").hexdigest()
    copy = (F.col("doc_id") != F.col("rep")) & (F.col("n_words") >= window)
    rows = profile.join(classes.select("print", "rep"), "print").join(changed, "doc_id", "left")
    return rows.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"), F.when(copy, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: The same rows by brute force: every window of every document, and the first document of each.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, unnest(range(1, len(t) - 48)) AS i, t FROM w WHERE len(t) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(t[i:i + 49], ' ')) AS x FROM g),
f AS (SELECT x, min(doc_id) AS first FROM h GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (x) WHERE first < doc_id),
d AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
r AS (SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             CASE WHEN gone IS NULL THEN t ELSE list_transform(list_filter(range(1, len(t) + 1), lambda i: NOT list_contains(gone, i)), lambda i: t[i]) END AS kept
      FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""
