"""Mentions, alike titles, memory edges and the calculator against plain forms on random rows."""

import itertools
import random
from difflib import SequenceMatcher

import pytest

from corpusmill.functions.requests import calculate
from corpusmill.operators import memory, places


def test_alike_titles(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("中华人民共和国法条例规定办实施细则") for _ in range(rng.choice((1, 2, 5, 7, 12, 13, 20, 30, 45, 80)))) for _ in range(60)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 8))):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "国", "试", "行行"])
        return "".join(t) or "法"

    left, right = sorted({changed(t) for t in base} | set(base)), sorted({changed(t) for t in base for _ in range(3)})
    want = {}
    for a in left:
        alike = [(r, b) for b in right if (r := SequenceMatcher(None, a, b).ratio()) >= places.ALIKE]
        if alike:
            want[a] = max(alike)[1]
    df = lambda x: spark.createDataFrame([(t,) for t in x], "key string")
    got = {r["key"]: r["other"] for r in places.alike_titles(df(left), df(right)).collect()}
    assert got == want and len(want) > 40
    assert places.alike_titles(df(left).limit(0), df(right)).collect() == []


def test_mentions(spark):
    names = ["京", "北京", "北京市", "内蒙古自治区", "新疆维吾尔自治区巴音郭楞蒙古自治州", "", "ab"]
    texts = [(1, "在北京市和新疆维吾尔自治区巴音郭楞蒙古自治州"), (2, "京"), (3, ""), (4, None), (5, "内蒙古"), (6, "xaby内蒙古自治区"), (7, "a"), (8, "北京北京")]
    known = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "alias string, code string")
    got = sorted(map(tuple, places.mentions(spark.createDataFrame(texts, "id int, text string"), known, "id", "text").collect()))
    assert got == sorted((i, str(k)) for i, t in texts for k, n in enumerate(names) if n and t and n in t)


def test_memory_edges(spark):
    rng = random.Random(5)
    pick = lambda words, n: rng.sample(words, rng.randint(0, n))
    rows = [(i % 3, i, rng.choice(["profile", "semantic", "episodic"]), rng.choice(["x", "y"]), i % 4, pick(["r1", "r2"], 1), pick(list("abcdef"), 3), ["common", *pick(list("klmnop"), 4)] if i % 2 else pick(list("klmnop"), 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "user int, id int, layer string, category string, session int, refs array<string>, tags array<string>, keywords array<string>")
    got = {(r["user"], r["a"], r["b"]): r["weight"] for r in memory.edges(df).collect()}
    ratio = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0
    want = {}
    for p, q in itertools.combinations(rows, 2):
        if p[0] != q[0]:
            continue
        refs, tags, words = len(set(p[5]) & set(q[5])), ratio(p[6], q[6]), ratio(p[7], q[7])
        w = (min(0.5, 0.28 + 0.08 * refs) if refs else 0) + (min(0.28, 0.08 + 0.22 * tags) if tags else 0) + (min(0.18, 0.05 + 0.16 * words) if words else 0) + 0.06 * (p[4] == q[4]) + 0.04 * (p[3] == q[3])
        w += 0.04 * (p[2] == q[2] == "semantic") + 0.06 * (bool(refs or tags or words) and "profile" in (p[2], q[2]))
        if min(0.95, w) >= 0.18:
            want[p[0], p[1], q[1]] = pytest.approx(min(0.95, w), abs=2e-6)
    assert got == want and len(want) > 50


@pytest.mark.parametrize(
    "text,value",
    [
        ("1+2*3", 7), ("(12.35-0.35)/4", 3), ("3万+2百", 30200), ("1,000 元 * 5%", 50), ("10 % 3", None), ("__import__('os')", None), ("1/0", None), ("", None), (None, None), ("2**10", 1024), ("9**9**9", None), ("round(10/4, 1)", 2.5), ("-（2＋3）", -5), ("3x4", 12), ("2^3", 8), ("3倍*2", 6), ("1。5+1", 2.5), ("min(1, 2.5)", 1), ("max(1, 2)", None),
        ("20％ * 50", 10), ("1,234,567+1", 1234568), ("1,23", None), ("5块钱+3块", 8), ("2亿/1千", 200000), ("7 // 2", 3), ("100*12%%", None), ("+5", 5), ("abs(-3)", 3),
    ],
)
def test_calculate(text, value):
    assert calculate(text) == value
