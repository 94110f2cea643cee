"""Grades and units against their SQL on rows made for them, and how long grades take."""

import time

import duckdb
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions import text as T
from corpusmill.plans import bank, corpus


def test_grades_in_time(spark):
    """Tokens of an answer are cut once, not once for each of them."""
    rows = spark.range(2_000).select(F.concat(F.lit("应当返还押金并支付利息；承租人可以起诉；"), F.col("id").cast("string")).alias("a"), F.lit("应当返还押金并支付利息；承租人可以起诉出租人；").alias("b"))
    began = time.time()
    got = rows.select(R.subjective_ratio(F.col("a"), F.col("b")).alias("r"), T.token_f1(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("f")).agg(F.min("r"), F.max("r"), F.min("f"), F.max("f")).first()
    assert time.time() - began < 20
    assert got[0] == got[1] == 1.0 and got[2] == got[3]


def test_rollup_is_dealt(spark, tmp_path):
    """A small table that much work is done for is dealt over all cores."""
    spark.range(100).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert bank.EXAM.df(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_units_keep_signs(spark, tmp_path):
    """Plus signs, brackets with spaces and vertical tabs in a text stay as they are."""
    texts = ["a + b + c + d + e", "++++++++++++++++", "（ x ） 《 y 》 + z", "one\x0btwo\x0b three", "  \t \n x", "", None]
    rows = [(i, texts[i % len(texts)] and texts[i % len(texts)] * 20) for i in range(240)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    df = corpus.article_units(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({corpus.SQL['article_units']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) > 50


def test_calculated_by_form():
    """By its form an expression has the value that it has by itself, also where signs join numbers."""
    import random

    from corpusmill.functions import requests as Q

    rng = random.Random(5)
    pieces = ["1", "23", "007", "4.5", "1e3", "0x1F", "1_0", "12345678901234567", "５", ",", "，", "。", ".", "倍", "x", "X", "×", "÷", "^", "+", "-", "*", "/", "//", "%", "％", "万", "百", "元", "块钱", "(", ")", " ", "min(", "round(", "abs(", "max(", "a", "if", "'", "345", "100", "0"]
    fixed = ["12x345元", "-（3＋4）", "5％ * 30", "7^2", "7^65", "3倍*2块钱", "3万+2百", "min(3, 4)", "8 % 3", "1，234。5－6", "9//7 ＋ 10÷4", "1/0", "5,倍345", "round(2.567, 2)", "round(2.5)", "", None, "5倍3", "min(1,234, 5)", "2^-1", "(-8)^0.5"]
    own = fixed + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert [x for x in own if repr(Q.calculated(x)) != repr(Q.calculate(x))] == []
    Q._form.cache_clear()
    for i in range(1_000):
        Q.calculated(f"{i}x{i + 7}元")
    assert Q._form.cache_info().misses == 1


def test_distinct_in_parts(spark):
    """The number of tasks follows the number of rows."""
    from corpusmill.operators import ranking

    df = spark.range(3_000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("b"))
    got = ranking.distinct_in_parts(df, 100 * ranking.DISTINCT_ROWS, "a", "b")
    assert got.rdd.getNumPartitions() == 100 and got.count() == 350
