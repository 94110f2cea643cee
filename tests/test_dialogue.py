"""Keywords, overlaps, short questions and search queries, on texts written here."""

from pyspark.sql import functions as F

from corpusmill.functions import dialogue as D


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_tokens(spark):
    none = F.lit(None).cast("string")
    assert values(spark, D.significant(F.lit("law 7 12 x 押金")), D.significant(none), D.keywords(F.lit("tax 3.5% tax")), D.keywords(none)) == [["law", "12", "押金"], [], ["tax", "3.5%"], []]
    assert values(spark, D.overlap(F.lit("tax rate"), F.lit("tax law")), D.overlap(F.lit(""), F.lit("tax"))) == [1 / 3, 0.0]


def test_predicates(spark):
    asked = F.array(F.lit("金额？"), F.lit("您的所在地？"))
    assert values(spark, D.wants_precise(F.lit("罚 款多少")), D.wants_computation(F.lit("怎么处理")), D.asks_place(F.lit("哪个省")), D.asked_where(asked), D.asked_where(F.slice(asked, 1, 1))) == [True, False, True, True, False]
    assert values(spark, D.statute_dump(F.lit("第一条" * 4)), D.statute_dump(F.lit("第一条" * 4 + "文" * 260)), D.is_clarification(F.lit("请" * 121)), D.is_clarification(F.lit(""))) == [False, True, False, False]


def test_queries(spark):
    lines = "\n".join(["a" * 100, "b" * 100, "c" * 100])
    assert values(spark, D.compact_question(F.lit(lines)), D.compact_question(F.lit("x" * 300)), D.compact_question(F.lit(" short\n"))) == ["a" * 100 + " " + "b" * 100, "x" * 220, "short"]
    asked = "原始法律问题：tax due\n已补充事实：\n- 税率：5%\n"
    assert values(spark, D.search_query(F.lit(asked)), D.search_query(F.lit(None).cast("string"))) == ["tax due 5% tax due", ""]
