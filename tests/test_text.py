from pyspark.sql import functions as F

from corpusmill.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_titles(spark):
    assert one(spark, T.normalize_title(F.lit("《中华人民共和国民法典》"))) == "中华人民共和国民法典"
    assert one(spark, T.normalize_title(F.lit("最高人民法院+最高人民检察院关于批复_20200101"))) == "最高人民法院 最高人民检察院关于批复"
    assert one(spark, T.normalize_title(F.lit("《湖南省实施_中华人民共和国种子法_办法》"))) == "湖南省实施 中华人民共和国种子法 办法"
    assert one(spark, T.title_aliases(F.lit("中华人民共和国民事诉讼法"))) == ["中华人民共和国民事诉讼法", "民事诉讼法"]
    assert one(spark, T.cross_references(F.lit("《民法典》和《刑法》以及《民法典》"))) == ["民法典", "刑法"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Law 第一条"))) == ["law", "第", "一", "条", "第一", "一条"]
    assert one(spark, T.tokens(F.lit(""))) == []


def test_windows(spark):
    assert one(spark, T.char_windows(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, T.char_windows(F.lit("abc"), 4, 1)) == ["abc"]
    assert one(spark, T.char_windows(F.lit(" "), 4, 1)) == []
    assert one(spark, T.char_windows(F.lit("a+b  c é𝒳d"), 4, 2)) == ["a b", "b c", "c é𝒳", "é𝒳d"]


def test_headings(spark):
    assert one(spark, T.article_heading(F.lit("第十二条 内容"))) == "第十二条"
    assert one(spark, T.section_heading(F.lit("第三章 总则"))) == "第三章"
