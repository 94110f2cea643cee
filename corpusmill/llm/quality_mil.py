"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as a
vector of character and word statistics; a hidden layer embeds it; gated
attention (tanh and sigmoid branches) weighs the passages of a document, and a
logistic unit scores the weighted representation. All weights are learned from
document labels alone, by gradient steps on a sample of at most TRAIN_ROWS
labelled documents, chosen by a hash of their ids, with all their passages. Only
the text is an input.

Null and empty texts are bags without passages: their score is that of a zero
representation. Texts of any length are read whole. Without labelled rows every
score is 0.5. Repeated labels of a document count once, by the larger. Repeated
documents give repeated results, an empty table an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import slices, word_hashes, words
from ._memory import mapped
from ._store import table

PASSAGE = 48
#: The bound of the training sample in documents, and passages of a gradient step, about: a long document is a step by itself.
TRAIN_ROWS, STEP_PASSAGES = 8_000, 16_384
CUT = 0.3
FOLDS, HELD_OUT = 5, 0
HIDDEN, GATE = 16, 8

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-", "!?", "*#%$&@^~=+", "|", "<>_/\\{}[]()`", "\n"]
_ALL = np.zeros((len(_CLASSES) + 1, 256), dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _ALL[_i, [ord(c) for c in _chars]] = 1
_ALL[-1, 128:] = 1
WIDTH = len(_ALL) + 8


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of WIDTH numbers a passage, and for each document its number of passages."""
    starts, ends, first = words(raw, offsets)
    counts = np.diff(first)
    bags = -(-counts // PASSAGE)
    if not len(starts):
        return np.zeros((0, WIDTH), np.float32), bags
    place = np.arange(len(starts)) - np.repeat(first[:-1], counts)
    heads = np.flatnonzero(place % PASSAGE == 0)
    sizes = np.diff(np.append(heads, len(starts)))
    x = np.zeros((len(heads), WIDTH), dtype=np.float64)
    low, high = starts[heads], ends[np.append(heads[1:], len(starts)) - 1]
    for k, row in enumerate(_ALL):
        total = np.concatenate([[0], np.cumsum(row[raw], dtype=np.int64)])
        x[:, k] = (total[high] - total[low]) / (high - low)
    n = len(_ALL)
    head_byte, tail_byte = raw[starts], raw[ends - 1]
    letters = ends - starts
    passage = np.repeat(np.arange(len(heads)), sizes)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=len(heads)) / sizes

    upper = np.concatenate([[0], np.cumsum(_ALL[1][raw], dtype=np.int64)])
    lower = np.concatenate([[0], np.cumsum(_ALL[0][raw], dtype=np.int64)])
    x[:, n] = mean(letters) / 10
    x[:, n + 1] = mean(_ALL[1][head_byte])
    x[:, n + 2] = mean((upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts]))
    x[:, n + 3] = mean((_ALL[5] | _ALL[7])[tail_byte])
    x[:, n + 4] = mean(_ALL[4][tail_byte])
    x[:, n + 5] = mean(_ALL[3][tail_byte])
    h = word_hashes(raw, starts, ends, lower=True)
    order = np.lexsort((h, passage))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[:, n + 6] = np.bincount(passage[order][fresh], minlength=len(heads)) / sizes
    x[:, n + 7] = sizes / PASSAGE
    return x.astype(np.float32), bags


def _segments(bags: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bags)), bags)


class Model:
    """Weights by name; ``mean`` and ``spread`` scale the encodings."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = {"e": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "eb": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, dict]:
        w, seg = self.w, _segments(bags)
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
        logits = (t * s) @ w["a"]
        top = np.full(len(bags), -np.inf)
        np.maximum.at(top, seg, logits)
        e = np.exp(logits - top[seg])
        alpha = e / np.bincount(seg, weights=e, minlength=len(bags))[seg]
        z = np.zeros((len(bags), HIDDEN))
        np.add.at(z, seg, alpha[:, None] * h)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return score, {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "seg": seg}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict:
        w = self.w
        score, k = self.forward(x, bags)
        d = (score - y) / len(y)
        g = {"c": k["z"].T @ d, "b": np.array([d.sum()])}
        dz = d[:, None] * w["c"]
        dh = k["alpha"][:, None] * dz[k["seg"]]
        da = (k["h"] * dz[k["seg"]]).sum(axis=1)
        dl = k["alpha"] * (da - np.bincount(k["seg"], weights=k["alpha"] * da, minlength=len(bags))[k["seg"]])
        gate = k["t"] * k["s"]
        g["a"] = gate.T @ dl
        dt, ds = dl[:, None] * w["a"] * k["s"] * (1 - k["t"] ** 2), dl[:, None] * w["a"] * gate * (1 - k["s"])
        g["v"], g["u"] = k["h"].T @ dt, k["h"].T @ ds
        dh = (dh + dt @ w["v"].T + ds @ w["u"].T) * (1 - k["h"] ** 2)
        g["e"], g["eb"] = k["x"].T @ dh, dh.sum(axis=0)
        return g


def _steps(order: np.ndarray, bags: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Documents in order, at most ``batch`` and about STEP_PASSAGES passages at a time."""
    at, through = 0, np.concatenate([[0], np.cumsum(bags[order])])
    while at < len(order):
        to = min(at + batch, max(at + 1, int(np.searchsorted(through, through[at] + STEP_PASSAGES, side="right")) - 1))
        yield order[at:to]
        at = to


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02) -> Model:
    """Adam on batches of documents, in an order fixed by a seed."""
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3)
    share = np.clip(y.mean(), 0.01, 0.99)
    model.w["b"][0] = np.log(share / (1 - share))
    edges = np.concatenate([[0], np.cumsum(bags)])
    rng, step = np.random.default_rng(5), 0
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for own in _steps(order, bags, batch):
            rows = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in own])
            step += 1
            for k, g in model.gradients(x[rows], bags[own], y[own]).items():
                g = g + 1e-4 * model.w[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                model.w[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in slices(batch):
            x, bags = encode(raw, offsets)
            edges = np.concatenate([[0], np.cumsum(bags)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["doc_id", "quality", "bag"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of at most ``rows`` labelled documents of the training folds."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    got = mapped(sample.select("doc_id", "text", "quality"), _bags, "doc_id bigint, quality int, bag binary").orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(rows).toArrow()
    if not got.num_rows:
        return None
    parts = [np.frombuffer(b.as_buffer(), dtype=np.float32).reshape(-1, WIDTH) for b in got.column("bag")]
    x = np.concatenate(parts).astype(np.float64)
    if not len(x):
        return None
    return fit(x, np.array([len(p) for p in parts]), got.column("quality").to_numpy().astype(np.float64))


def _score(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, 1 << 20):
                if model.value is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    x, bags = encode(raw, offsets)
                    scores, _ = model.value.forward(x.astype(np.float64), bags)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score. One pass, no shuffle; the model is of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(own, _score(shared), "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
