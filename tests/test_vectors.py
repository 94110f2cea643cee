"""The stored vector index against full scans, before and after upserts."""

import os

import numpy as np
import pytest

from corpusmill.operators import vectors
from corpusmill.sources import published

SCHEMA = "vid bigint, emb array<float>, label string"


def _rows(rng, n, clusters=6, width=12, spread=0.05):
    centres = rng.normal(size=(clusters, width))
    v = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))
    v *= rng.uniform(0.5, 2.0, (n, 1)) if spread > 0.5 else 1 / np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), [float(np.float32(x)) for x in row], f"l{i % 3}") for i, row in enumerate(v)]


def _scan(rows, query, k):
    scored = [(round(sum(a * b for a, b in zip(v, query)), 6), i) for i, v, _ in rows]
    return sorted(((-s, i) for s, i in scored))[:k]


@pytest.mark.parametrize("spread", [0.05, 0.8])
def test_search_and_upsert(spark, tmp_path, spread):
    rng = np.random.default_rng(5)
    rows = _rows(rng, 400, spread=spread)
    df = spark.createDataFrame([*rows, (None, rows[0][1], "x"), (9000, None, "x"), (9001, [1.0, None], "x")], SCHEMA)
    index = vectors.build(spark, str(tmp_path / "i"), df, "vid", "emb", cells=16)
    shares = []
    for q in (rows[3][1], [-x for x in rows[5][1]], list(rng.normal(size=12)), [0.0] * 12):
        got = [(-r["score"], r["id"]) for r in index.search(q, 7, first=1).collect()]
        assert np.allclose([s for s, _ in got], [s for s, _ in _scan(rows, q, 7)], atol=2e-6)
        assert sorted(i for _, i in got) == sorted(i for _, i in _scan(rows, q, 7)) or any(q[i] == 0 for i in range(12))
        shares.append(index.share_read())
        lengths = {c: [sum(a * b for a, b in zip(r["vector"], q)) for r in index.read([c]).collect()] for c in index.cells}
        assert all(max(x) <= index.bounds(q)[c] for c, x in lengths.items())
    if spread < 0.5:
        assert shares[0] < 0.5  # most cells are not opened
    before = {c: known["at"] for c, known in index.cells.items()}
    changed = [(7, rows[8][1], "new"), (5000, rows[9][1], "new"), (7, rows[8][1], "new")]
    after = index.upsert(spark.createDataFrame(changed, SCHEMA), "vid", "emb")
    want = sorted([r for r in rows if r[0] != 7] + [changed[0], changed[1]])
    assert sorted((r["id"], list(map(float, np.float32(r["vector"]))), r["label"]) for r in after.rows().collect()) == want
    moved = {c for c in before if after.cells[c]["at"] != before[c]}
    assert 1 <= len(moved) <= 3  # the cells of old and new places only
    assert len(os.listdir(f"{tmp_path}/i/{after.version.version}/cells")) <= 3 + 2
    assert sorted(r["id"] for r in index.rows().collect()) == [r[0] for r in rows]  # the older version goes on
    again = after.upsert(spark.createDataFrame(changed, SCHEMA), "vid", "emb")
    assert sorted((r["id"], r["label"]) for r in again.rows().collect()) == [(i, lab) for i, _, lab in want]
    assert published.current(spark, str(tmp_path / "i")).seq == 2


def test_empty(spark, tmp_path):
    index = vectors.build(spark, str(tmp_path / "e"), spark.createDataFrame([], SCHEMA), "vid", "emb")
    assert index.search([1.0], 3).collect() == [] and index.share_read() == 0
    with pytest.raises(FileNotFoundError):
        vectors.VectorIndex(spark, str(tmp_path / "none"))
