"""Secret scan: fixed patterns, and random-looking strings found by character Markov models.

Two order-1 character models are trained from labelled samples, one of random
strings (keys in base 16, 32, 62 and 64) and one of ordinary identifiers and
words. A candidate is a run of key characters, or what pattern spans leave of it,
of LEAST characters or more. It is a secret when its log-likelihood ratio, summed,
outweighs the prior odds against a secret, and its mean per character is above a
threshold; where the whole run is none, its parts between separators are asked.
Patterns always stay; a model span overlaps no pattern span.

A null text is empty. Texts of any length are read whole; a run of any length is
one candidate. Offsets are code points, ends exclusive. Spans are joined
by commas in order of start, then kind as listed in KINDS; no span gives "".
Repeated rows give repeated results, an empty table an empty result, and other
columns are passed over.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import mapped
from ._store import table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Equal to the runs of AKIA[A-Z0-9]+ of 16 characters or more, and of [0-9a-f]+ of 32 or more: each run is taken whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
#: Candidates of the models: runs of at least so many of these characters.
LEAST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PART = re.compile(r"[A-Za-z0-9]{8,}")
EDGES = "=-_/+"
#: Nats by which the random model must be likelier: per character, and in all (the prior odds are one in a million).
THRESHOLD, PRIOR = 0.35, math.log(1e6)
#: Runs whose verdict a worker keeps, each of at most KEPT_LENGTH characters; beyond, all are judged again.
KEPT, KEPT_LENGTH = 200_000, 64

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = {c: i for i, c in enumerate(_ALPHABET)}
_WORDS = (
    "the of and to in is it that was for on are with as be at this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know "
    "get set index value buffer string number count size list table column result error handler request response config context manager session user name file path directory version build test module package import export function method class object array map filter reduce join group order limit offset query parse format encode decode stream reader writer socket server client default option parameter argument template image button layout margin padding color border width height position absolute relative container header footer content article section summary description title link page document element attribute node child parent root tree graph edge vertex "
    "une des les dans pour avec sur est que qui pas plus par ce cette nous vous mais ou donc entre aussi comme tout faire être avoir der die das und ist nicht mit von zu den dem ein eine auf für sich werden haben sein oder aber auch nach wie über wenn noch el la los las una por para con como pero sus más este esta ser hacer tiene entre cuando muy sin sobre también"
).split()


def labelled_samples(seed: int = 7, each: int = 4000) -> list[tuple[str, int]]:
    """The default training set: (string, 1) for random keys, (string, 0) for identifiers, words, paths, numbered and invented names, and repeated characters."""
    rng = random.Random(seed)
    bases = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", _ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    found = [("".join(rng.choice(bases[i % 5]) for _ in range(rng.randint(20, 64))), 1) for i in range(each)]
    joins: tuple[Callable[[list[str]], str], ...] = (
        "_".join, "-".join, "/".join, "".join, lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "_".join(x.upper() for x in w), lambda w: "".join(x.title() for x in w),
        lambda w: "_".join(w) + str(rng.randint(0, 9999)), lambda w: "-".join(w) + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda w: "/".join(w) + f"/{rng.randint(1, 99999)}",
    )
    for i in range(each):
        found.append((joins[i % len(joins)]([rng.choice(_WORDS) for _ in range(rng.randint(3, 7))]), 0))
    found += [("".join(rng.choice("0123456789") for _ in range(rng.randint(20, 40))), 0) for _ in range(each // 10)]
    found += [(rng.choice(_ALPHABET) * rng.randint(20, 60), 0) for _ in range(each // 10)]
    # names of languages not listed: syllables of any consonants around a vowel
    vowels, others = "aeiouy", "bcdfghjklmnpqrstvwxz"
    for _ in range(each):
        name = "".join(rng.choice(others) * (rng.random() < 0.8) + rng.choice(vowels) + rng.choice(vowels) * (rng.random() < 0.3) + rng.choice(others) * (rng.random() < 0.4) for _ in range(rng.randint(3, 9)))
        found.append((rng.choice((name, name.title())), 0))
    return found


class MarkovScorer:
    """Log-likelihood ratio per character of two character models with add-one smoothing."""

    def __init__(self, samples: Iterable[tuple[str, int]]):
        size = len(_ALPHABET) + 1
        counts = [[[1.0] * size for _ in range(size)] for _ in range(2)]
        for text, label in samples:
            at = size - 1
            for c in text:
                to = _INDEX.get(c, size - 1)
                counts[label][at][to] += 1
                at = to
        logs = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
        self.ratio = [[logs[1][a][b] - logs[0][a][b] for b in range(size)] for a in range(size)]
        self.kept: dict[str, list[tuple[int, int]]] = {}

    def total(self, text: str) -> float:
        total, at, end = 0.0, len(_ALPHABET), len(_ALPHABET)
        for c in text:
            to = _INDEX.get(c, end)
            total += self.ratio[at][to]
            at = to
        return total

    def score(self, text: str) -> float:
        """The log-likelihood ratio per character."""
        return self.total(text) / len(text) if text else float("-inf")

    def is_secret(self, text: str, threshold: float = THRESHOLD) -> bool:
        return len(text) >= LEAST and (total := self.total(text)) > PRIOR and total > threshold * len(text)

    def found_in(self, run: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
        """Secrets in a run: the run without its edges, or else those of its parts between separators."""
        if threshold == THRESHOLD and (known := self.kept.get(run)) is not None:
            return known
        bare = run.strip(EDGES)
        if self.is_secret(bare, threshold):
            at = run.index(bare)
            found = [(at, at + len(bare))]
        else:
            found = [m.span() for m in PART.finditer(run) if len(m[0]) < len(bare) and self.is_secret(m[0], threshold)]
        if threshold == THRESHOLD and len(run) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[run] = found
        return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def model_spans(text: str, base: list[tuple[int, int, int]], scorer: MarkovScorer, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    found, next_ = [], 0
    base = sorted(base)
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while next_ < len(base) and base[next_][2] <= start:
            next_ += 1
        if next_ == len(base) or base[next_][0] >= end:
            found += [(start + a, 3, start + b) for a, b in scorer.found_in(m[0], threshold)]
            continue
        at = start
        for k in range(next_, len(base)):  # what pattern spans leave of the run
            s, _, e = base[k]
            if s >= end:
                break
            found += [(at + a, 3, at + b) for a, b in scorer.found_in(text[at:s], threshold)] if s - at >= LEAST else []
            at = max(at, e)
        found += [(at + a, 3, at + b) for a, b in scorer.found_in(text[at:end], threshold)] if end - at >= LEAST else []
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(text: str | None, scorer: MarkovScorer) -> tuple[list, list]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + model_spans(text, base, scorer))


def _scan(samples: list[tuple[str, int]] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = MarkovScorer(samples or labelled_samples())
        for batch in batches:
            rows = [spans_of(x.as_py(), scorer) for x in batch.column(1)]
            kinds = [[sum(k == kind for _, k, _ in base) for base, _ in rows] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(k, pa.int64()) for k in kinds), pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([_joined(found) for _, found in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, counts of pattern spans by kind, the digest of pattern spans, and all spans. One pass, no shuffle."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(own, _scan(samples), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str | None, scorer: MarkovScorer, mask: str) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by ``mask``."""
    if text is None:
        return None
    out, at = [], 0
    for start, _, end in spans_of(text, scorer)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """All columns and rows of ``docs``, secrets in ``text`` replaced; n_chars, if there, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = MarkovScorer(samples or labelled_samples())
        for batch in batches:
            at, old = batch.schema.get_field_index("text"), batch.column("text").to_pylist()
            new = [redacted(x, scorer, mask) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                columns[k] = pa.array([c if x == y else len(y) for c, x, y in zip(columns[k].to_pylist(), old, new)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
