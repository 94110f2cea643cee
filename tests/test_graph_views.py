"""Related and similar nodes of many asked ones: the rows of the SQL on odd tables, and no row for each pair."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import blocks, graph
from corpusmill.plans import stores


def _most_rows(plan) -> int:
    """The largest number of rows that a step of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    own = plan.metrics().get("numOutputRows")
    children = plan.children()
    return max([own.get().value() if own.isDefined() else 0, *(_most_rows(children.apply(i)) for i in range(children.size()))])


def _ran(df):
    """Its rows, and the most rows of a step."""
    got = [tuple(r) for r in df.collect()]
    return got, _most_rows(df._jdf.queryExecution().executedPlan())


def test_one_shared_target(spark):
    """4,000 sources share a target and 200 of them are asked: 800,000 pairs."""
    own = spark.range(4_000).select(F.col("id").alias("source"), F.explode(F.array(F.lit("hub"), F.concat(F.lit("t"), (F.col("id") % 500).cast("string")))).alias("target"))
    asked = spark.range(0, 4_000, 20).withColumnRenamed("id", "asked")
    got, most = _ran(graph.related(asked, own, 10))
    want = []
    for a in range(0, 4_000, 20):
        near = [(n, 2) for n in range(a % 500, 4_000, 500) if n != a] + [(n, 1) for n in range(20) if n % 500 != a % 500]
        want += [(a, n, s, r + 1) for r, (n, s) in enumerate(near[:10])]
    assert sorted(got) == sorted(want)
    assert most < 100_000


def test_all_vectors(spark):
    """As many pairs of vectors, of which many are copies."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4_000, 8)).astype(np.float32)
    x[500:1_500] = x[500]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vector array<float>")
    asked = vectors.filter("node % 20 = 0").withColumnRenamed("node", "asked")
    got, most = _ran(graph.similar(asked, vectors, 3).select("asked", "node", "rank"))
    want, y = [], x.astype(float)
    for a in range(0, 4_000, 20):
        score = np.zeros(4_000)
        for d in range(8):
            score += y[a, d] * y[:, d]
        near = [i for i in np.lexsort((np.arange(4_000), -np.round(score, 6)))[:4] if i != a][:3]
        want += [(a, int(n), r + 1) for r, n in enumerate(near)]
    assert sorted(got) == sorted(want)
    assert most < 100_000


def _odd(rng, i):
    v = [round(rng.gauss(0, 1), 2) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))]
    k = i % 16
    if k == 3:
        v[rng.randrange(len(v))] = None
    return None if k == 5 else [] if k == 6 else [None] * 3 if k == 7 else [0.0] * 3 if k == 8 else [1.0, 2.0, 3.0] if k in (9, 10) else [v[0], math.inf, 0.5] if i == 27 else [v[0], 1.0, math.nan] if i == 60 else [1e30, v[0], -1e30] if i == 100 else v


@pytest.mark.parametrize("small", [False, True])
def test_odd_tables(spark, tmp_path, monkeypatch, small):
    """Ids that are null or come again, vectors of several lengths with null, infinite and no components; in one square and in many."""
    if small:
        monkeypatch.setattr(blocks, "BLOCK", 2)
        monkeypatch.setattr(blocks, "GROUP", 40)
    rng = random.Random(6)
    page = lambda: "".join(f'<a href="/{rng.choice("abcdefghij")}{rng.choice("12")}">' for _ in range(rng.randrange(6)))
    pages = [(i, page()) for i in range(400)] + [(50, page()), (50, '<a href="/a1"><a href="/a1">'), (None, page()), (7, page()), (401, None)]
    vectors = [(i, _odd(rng, i)) for i in range(400)] + [(100, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (13, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0])]
    for n, i in enumerate(range(0, 400, 50)):  # asked ones of each kind
        vectors[i] = (i, [None, [], [None] * 3, [1.0, None, 3.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [0.0] * 3, [1.0, math.inf, 1.0]][n])
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in stores.node_view(spark, str(tmp_path)).select("asked", "part", "node", "rank").collect()]
    want = con.execute(f"SELECT asked, part, node, rank FROM ({stores.SQL['graph_node_view']})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {p for _, p, _, _ in got} == {"cites", "related", "similar"}


@pytest.mark.parametrize("how", [blocks.Products, blocks.Shared])
def test_slices(monkeypatch, how):
    """Squares in batches, of which each is cut into slices of a few rows and worked on in steps, against all pairs."""
    for name, n in (("HELD", 2), ("FIRST", 1), ("SLICE", 7), ("AT_ONCE", 9)):
        monkeypatch.setattr(blocks, name, n)
    rng = random.Random(7)
    product = how is blocks.Products
    value = (lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]) if product else lambda: sorted(rng.sample("abcdefg", rng.randrange(6)))
    kind = pa.list_(pa.float64() if product else pa.string())
    score = (lambda a, b: sum(x * y for x, y in zip(a, b))) if product else lambda a, b: float(len(set(a) & set(b)))
    rows, want = [], {}
    for square, asked, others in ((3, 5, 90), (4, 0, 10), (5, 3, 0), (8, 1, 40)):
        own, met = [value() for _ in range(asked)], [value() for _ in range(others)]
        rows += [(square, 0, 100 * square + i, 1, None, v) for i, v in enumerate(own)] + [(square, 1, None, None, i, v) for i, v in enumerate(met)]
        for i, a in enumerate(own):
            near = sorted((-score(a, b), j) for j, b in enumerate(met) if product or score(a, b))[:3]
            if near:
                want[100 * square + i] = [(j, -s) for s, j in near]
    schema = pa.schema([("square", pa.int64()), ("side", pa.int32()), ("asked", pa.int64()), ("times", pa.int32()), ("node", pa.int64()), ("value", kind)])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    for size in (4, 1_000):
        got = {}
        for batch in blocks._squares(how, 3)(iter(whole.to_batches(max_chunksize=size))):
            for r in batch.to_pylist():
                got.setdefault(r["asked"], []).append((r["node"], r["score"]))
        assert got == want and len(got) >= 5


def test_empty(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "node bigint, vector array<double>")
    asked = vectors.withColumnRenamed("node", "asked")
    assert graph.similar(asked.filter("false"), vectors, 3).collect() == [] and graph.similar(asked, vectors.filter("false"), 3).collect() == []
    links = spark.createDataFrame([], "source bigint, target string")
    assert graph.related(asked.select("asked"), links, 3).collect() == []
