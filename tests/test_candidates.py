"""Long texts, files and draws of bank building, on rows written here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import candidates as C
from corpusmill.functions import seeds as S
from corpusmill.operators import lookup
from corpusmill.sources import catalogs, sft


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_summaries(spark):
    long = F.lit("甲乙丙。" * 10 + "x")
    assert values(spark, C.summary(long, 20, 3, False), C.summary(long, 7, 3, False), C.summary(F.lit("abc, def. ghi"), 5, 1), C.summary(F.lit("abcdefgh"), 5, 1), C.summary(F.lit(None).cast("string"), 5, 1)) == ["甲乙丙。 甲乙丙。 甲乙丙。", "甲乙丙。", "abc", "", ""]
    assert values(spark, C.answer_summary(F.lit("一二三四五六七八九十一二：" + "长" * 90)), C.answer_summary(F.lit("短：" + "长" * 90))) == ["一二三四五六七八九十一二", "短"]
    assert values(spark, C.reference_answer(F.lit("长" * 700)), C.analysis(F.lit("解析：" + "长" * 1300), F.lit("对")), C.analysis(F.lit("解析：" + "长" * 900), F.lit("对"))) == ["长" * 679 + "…", "对", "长" * 900]


def test_long_questions(spark):
    pad = "事" * 600
    assert values(spark, C.freeform_question(F.lit(pad + "请问能退吗")), C.freeform_question(F.lit(pad + "。是否有效？好。")), C.freeform_question(F.lit(pad))) == ["能退吗", "是否有效？", "事" * 220]
    assert values(spark, C.choice_stem(F.lit(pad + "下列一，下列二？")), C.choice_stem(F.lit(pad))) == ["下列二？", ""]
    assert values(spark, C.case_question(F.lit("被告" + "事" * 900), F.lit("x")), C.case_question(F.lit("请分析" + "事" * 900), F.lit("x")), C.case_question(F.lit("无关"), F.lit("x"))) == [C.CASE_PROMPT + "\n被告" + "事" * (760 - len(C.CASE_PROMPT) - 3), "请分析" + "事" * 757, ""]


def test_cases(spark):
    assert values(spark, C.case_title(F.lit("民法"), F.lit("押金能退吗？")), C.case_title(F.lit("民法"), F.lit("")), C.case_title(F.lit("刑法"), F.lit("一，" + "事" * 50)), C.case_title(F.lit("刑法"), F.lit("事" * 50))) == ["民法案例：押金能退吗", "民法案例：未命名案例", "刑法案例：一", "刑法案例：" + "事" * 36]
    assert values(spark, C.case_issue(F.lit("甲" * 200 + "。" + "乙" * 50)), C.case_holding(F.lit(""), F.lit("判"))) == ["甲" * 200 + "。", "判"]
    assert values(spark, C.is_case(F.lit("被告不还钱"), F.lit(""), F.lit("exam")), C.is_case(F.lit("被告如何处理"), F.lit(""), F.lit("exam")), C.is_case(F.lit("问"), F.lit(""), F.lit("jud_doc_sum")), C.is_case(F.lit(None).cast("string"), F.lit(""), F.lit("exam"))) == [False, True, True, False]


def test_prompts(spark):
    text = "头" * 2000 + "本院认为" + "尾" * 1500
    (got,) = values(spark, S.compress_prompt(F.lit(text)))
    assert got == "头" * 1600 + S.CUT + text[1720:2900]
    early = "本院认为" + "事" * 3000
    assert values(spark, S.compress_prompt(F.lit(early)), S.compress_prompt(F.lit("事" * 3000))) == ["本院认为" + "事" * 1596 + S.CUT, "事" * 1600 + S.CUT + "事" * 900]


def test_draw(spark):
    def plain(sizes, limit):
        active, left, drawn, turn = sorted(b for b in sizes if sizes[b]), dict(sizes), [], 0
        while len(drawn) < limit:
            bucket = active[turn % len(active)]
            drawn.append(bucket)
            left[bucket] -= 1
            turn += 1
            if not left[bucket]:
                active.remove(bucket)
                turn = (turn - 1) % len(active) if active else 0
        return {b: drawn.count(b) for b in set(drawn)}

    rng = random.Random(5)
    for _ in range(300):
        sizes = {f"b{i}": rng.choice((0, 1, 2, 7, 40)) for i in range(rng.randint(1, 7))}
        limit = rng.randint(0, sum(sizes.values()))
        assert lookup.draw_quotas(sizes, limit) == plain(sizes, limit)
    with pytest.raises(ValueError, match="wanted"):
        lookup.draw_quotas({"a": 1}, 2)
    df = spark.createDataFrame([("a", i) for i in range(9)] + [(None, 1), ("b", 1)], "bucket string, n int").fillna("", "bucket")
    got = lookup.balanced_draw(df, "bucket", [F.desc("n")], 5).collect()
    assert sorted(map(tuple, got)) == [("", 1, 1), ("a", 6, 3), ("a", 7, 2), ("a", 8, 1), ("b", 1, 1)]
    assert lookup.balanced_draw(df, "bucket", [F.desc("n")], 0).count() == 0


def test_instruction_rows(spark, tmp_path):
    rows = [{"id": "exam-1", "input": "q", "output": "a", "reference": ["《甲》", "乙"]}, {"id": 7, "reference": "[x"}, {"id": "a_b-2", "input": "q", "reference": ""}]
    (tmp_path / "Set-One.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    got = sorted(map(tuple, sft.instruction_rows(spark, str(tmp_path / "*.jsonl")).collect()))
    assert got == [("7", "7", "Set-One", "", "", ["[x"]), ("a_b-2", "a_b", "Set-One", "q", "", []), ("exam-1", "exam", "Set-One", "q", "a", ["《甲》", "乙"])]


def test_catalogs(spark, tmp_path):
    head = "﻿标题 ,公布日期,施行日期,法律法规分类,other\n"
    (tmp_path / "a.csv").write_text(head + '民法典_20210101,2020-05-28 00:00,nan,"法律, x",1\n ,2020,,y,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + '民法典_20210101,2020-05-28,,"法律, x",3\n刑法,,1997-10-01,法律,4\n', encoding="utf-8")
    got = sorted(map(tuple, catalogs.master_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()))
    assert got == [("刑法", None, "1997-10-01", "法律", "刑法", "b.csv"), ("民法典_20210101", "2020-05-28", None, "法律, x", "民法典", "a.csv")]
    (tmp_path / "c.csv").write_text("标题\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="公布日期"):
        catalogs.read_catalog(spark, str(tmp_path / "c.csv"))
