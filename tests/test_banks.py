"""Rebuilt banks and exams against plain walks over small rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions.digests import md5_heads
from corpusmill.operators import banks, exams


def test_accepted(spark):
    """Chains of candidates that exclude each other by turns come out as a walk in order has them."""
    rng = random.Random(4)
    for case in range(3):
        rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for i in range(60)]
        if case == 2:
            rows = [(i, i // 2, (i + 1) // 2) for i in range(20)]
        seen = {"a": {3, 4}, "b": {5}}
        want, own = [], {k: set(v) for k, v in seen.items()}
        for i, a, b in rows:
            if (a is None or a not in own["a"]) and (b is None or b not in own["b"]):
                want.append(i)
                own["a"].add(a)
                own["b"].add(b)
        df = spark.createDataFrame(rows, "at int, a int, b int")
        known = {k: spark.createDataFrame([(x,) for x in v], f"{k} int") for k, v in seen.items()}
        assert sorted(r["at"] for r in banks.accepted(df, "at", ["a", "b"], known).collect()) == want


def test_scores(spark):
    df = spark.createDataFrame([("a",), ("",), ("法考",), (None,)], "x string")
    want = [None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in ("a", "", "法考", None)]
    assert [None if r[0] is None else int(r[0]) for r in df.select(banks.stable_score(F.col("x"))).collect()] == want


def test_preserved(spark):
    df = spark.createDataFrame([("gen-1",), ("own",), (None,), ("xgen-",)], "id string")
    assert [r["id"] for r in banks.preserved(df, "id", "gen-").collect()] == ["own", None, "xgen-"]


def test_exam_stages(spark):
    """Prioritised share, fresh before avoided, fallback, and a strict topic without questions."""
    bank = [(i, "t" if i < 40 else "u", "A" if i % 4 == 0 else "B", ["A"] if i % 4 == 1 else [], ("easy", "medium", "hard")[i % 3]) for i in range(50)]
    columns = "request string, topic string, exam string, n int, types array<string>, weak array<string>, goals array<string>, strong array<string>, recent array<int>, wrong array<int>, mastery double, seed string"
    weak, mixed, chapter = exams.WEAK, exams.MIXED, exams.CHAPTER
    users = [
        ("weak", "A", weak, 10, ["t"], ["A"], [], [], [], [0, 4, 8, 1], 0.5, "s"), ("fresh", "A", mixed, 6, ["t"], [], [], [], list(range(0, 32, 4)), [], 0.1, "s"), ("few", "A", chapter, 10, ["t"], [], [], ["B"], [0, 4, 8], [12], 0.9, "s"),
        ("none", "Z", chapter, 5, ["t"], [], [], [], [], [], 0.5, "s"), ("loose", "Z", None, 5, ["t"], [], [], [], [], [], 0.5, "s"), ("any", None, mixed, 20, ["u"], [], [], [], [41], [42], 0.5, "s"), ("elsewhere", "A", weak, 4, ["t"], [], [], [], [], [2, 3], 0.5, "s"), ("zero", "A", mixed, 0, ["t"], [], [], [], [], [], 0.5, "s"),
    ]
    asked = exams.plan(spark.createDataFrame(users, columns))
    hits = spark.createDataFrame([("A", 0, 0.03)], "topic string, id int, rrf double")
    got = {}
    rows = exams.sample(asked, spark.createDataFrame(bank, "id int, type string, topic string, tags array<string>, difficulty string"), hits).collect()
    for r in rows:
        got.setdefault(r["request"], []).append((r["place"], r["stage"], r["id"]))
    own = {k: [(s, i) for _, s, i in sorted(v)] for k, v in got.items()}
    of = lambda k, stage: {i for s, i in own[k] if s == stage}
    assert all([p for p, *_ in sorted(v)] == list(range(1, len(v) + 1)) and len({i for *_, i in v}) == len(v) for v in got.values())
    assert of("weak", 1) == {0, 4, 8} and len(own["weak"]) == 10 and all(i % 4 == 0 for _, i in own["weak"])  # id 1 is of the topic by a tag only
    fresh = set(i for i in range(40) if i % 4 == 1) | {32, 36}
    assert len(own["fresh"]) == 6 and of("fresh", 2) <= fresh
    assert {i for _, i in own["few"]} == set(range(0, 40, 4)) and len(own["few"]) == 10  # nothing of another topic; those to avoid are taken as they are needed
    assert "none" not in own and "zero" not in own and len(own["loose"]) == 5
    assert {i for _, i in own["any"]} == set(range(40, 50))
    assert of("elsewhere", 1) == {2, 3} and all(i % 4 == 0 for i in of("elsewhere", 2))
    again = exams.sample(asked, spark.createDataFrame(bank, "id int, type string, topic string, tags array<string>, difficulty string").repartition(3), hits).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert [spark.range(1).select(exams.priority_target(F.lit(e), F.lit(n), F.lit(found))).first()[0] for e, n, found in ((weak, 10, 20), (mixed, 10, 20), ("x", 5, 20), (chapter, 10, 3), (weak, 0, 5), (weak, 5, 0), (mixed, 1, 9))] == [7, 4, 2, 3, 0, 0, 1]


def test_best_draws(spark):
    """All pairs are drawn, few go on, and those are the least of each request."""
    questions = spark.range(40_000).select(F.col("id").alias("id"), (F.col("id") % 4).alias("kind"), F.lit("easy").alias("difficulty"))
    met = spark.range(4).select(F.lit("r").alias("request"), F.col("id").alias("kind"), F.lit(0).alias("quality"), F.lit(0).alias("preferred"), F.lit(0).alias("mastered"))
    met = met.union(met.filter("kind = 1").withColumn("request", F.lit("s")))
    lacks = spark.createDataFrame([("r", None, False, exams.MIXED, 0.5, "x", 7, 3), ("s", None, False, exams.MIXED, 0.5, "y", 2, 0)], "request string, topic string, topical boolean, exam string, mastery double, seed string, lack int, n_special int")
    k = exams._draw(F.col("id"), F.col("seed"), "2", F.lit(1.0))
    got = exams._best(met, lacks, questions, k, 20).groupBy("request").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("k", "id"))), 1, 10).alias("b"))
    got = {r["request"]: (r["n"], [tuple(x) for x in r["b"]]) for r in got.collect()}
    pairs = met.join(lacks, "request").join(questions, "kind").select("request", k.alias("k"), "id").collect()
    for r, deep in (("r", 10), ("s", 2)):
        assert got[r][1][:deep] == sorted((x["k"], x["id"]) for x in pairs if x["request"] == r)[:deep] and deep <= got[r][0] < 2_000


def test_digests_at_once():
    """First bytes of MD5 digests as hashlib gives them, over one block and more."""
    for head, tail in ((0, 0), (1, 3), (4, 5), (7, 12), (8, 47), (8, 48), (30, 40), (70, 70)):
        heads, tails = ([bytes((i * a + j) % 251 for j in range(n)) for i in range(m)] for n, m, a in ((head, 5, 7), (tail, 3, 11)))
        got = md5_heads(*(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) if x[0] else np.zeros((len(x), 0), np.uint8) for x in (heads, tails)))
        assert got.tolist() == [[int(hashlib.md5(x + y).hexdigest()[:8], 16) for x in heads] for y in tails]


def test_least_draws(monkeypatch):
    """The least draws of each request, whatever the pairs that are drawn at once; texts of several lengths, weights far apart, null and none."""
    monkeypatch.setattr(exams, "AT_ONCE", 64)
    rng = random.Random(3)
    heads, tails, deep = [str(i) for i in range(1_500)], [f":s{i}:2" for i in (1, 22, 23, 333)], np.array([3, 1, 40, 2_000])
    weights = np.array([rng.choice([0.01, 1.0, 1.0001, 300.0]) for _ in heads])
    weights[7], weights[8] = np.inf, 0.0
    i, j = exams._least(weights, pa.array(heads), pa.array(tails), deep)
    for r, tail in enumerate(tails):
        u = [(int(hashlib.md5((x + tail).encode()).hexdigest()[:8], 16) + 1) / 4294967297.0 for x in heads]
        order = sorted(range(len(heads)), key=lambda x: -math.log(u[x]) / weights[x] if weights[x] else math.inf)
        got = j[i == r].tolist()
        assert set(order[: deep[r]]) <= set(got) and len(set(got)) == len(got) <= deep[r] + 3
