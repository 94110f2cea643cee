"""Loaders and writers on rows written here."""

import json
import zipfile

import pytest

from corpusmill.sources import banks, docx, jsonl


def _write(path, rows):
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_question_bank(spark, tmp_path):
    rows = [
        {"id": 7, "stem": " Which? ", "options": {"A": "one", "B": "two"}, "tags": ["t", "law", "t"], "topic": "law", "score": 5, "analysis": "why"},
        {"question_id": "", "record_id": "r", "question": "Explain", "reference_answer": "because"},
        {},
    ]
    got = {r["record_id"]: r for r in banks.question_bank(spark, _write(tmp_path / "q.jsonl", rows)).collect()}
    assert set(got) == {"7", "r", ""}
    a, b, c = got["7"], got["r"], got[""]
    assert (a["title"], a["content"], a["tags"]) == ("Which?", "Which?\nA. one B. two\nwhy", ["law", "t"])
    assert (a["metadata"]["question_type"], a["metadata"]["evaluation_mode"], a["metadata"]["score"]) == ("single_choice", "objective_choice", 5)
    assert (b["content"], b["tags"], b["difficulty"], b["metadata"]["evaluation_mode"], b["metadata"]["score"]) == ("Explain\nbecause", [banks.TOPIC], "medium", "llm_subjective", 20)
    assert (c["title"], c["content"], c["metadata"]["options"]) == (banks.QUESTION_TITLE, "", {})


def test_case_and_common(spark, tmp_path):
    case = banks.case_bank(spark, _write(tmp_path / "c.jsonl", [{"case_title": "x", "summary": "f", "analysis": "h", "statutes": ["s", "t"], "tags": ["t"]}])).first()
    assert (case["record_id"], case["content"], case["tags"]) == ("x", "f\nh", ["t", "s"])
    common = banks.common_knowledge(spark, _write(tmp_path / "k.jsonl", [{"name": "n", "text": " body "}])).first()
    assert (common["record_id"], common["title"], common["content"], common["tags"], common["metadata"]["source"]) == ("n", "n", "body", [], banks.SOURCE)


def test_missing_and_malformed(spark, tmp_path):
    assert banks.case_bank(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id":')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_writes(spark, tmp_path):
    path = str(tmp_path / "bank")
    bank = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    jsonl.overwrite_jsonl(bank, path)
    read = jsonl.read_jsonl(spark, path, "id string, n int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3), (None, 4)], "id string, n int")
    jsonl.overwrite_jsonl(jsonl.insert_missing(read, new, "id"), path)
    jsonl.append_jsonl(spark.createDataFrame([("d", 4)], "id string, n int"), path)
    assert sorted(map(tuple, jsonl.read_jsonl(spark, path, "id string, n int").collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert [p.name for p in tmp_path.iterdir()] == ["bank"]


def test_docx(spark, tmp_path):
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    cells = "".join(f"<w:tc>{p(x)}</w:tc>" for x in ("a", "", "b"))
    inner = p("One") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>" + p(" ") + p(docx.BANNER + " more") + f"<w:tbl><w:tr>{cells}</w:tr><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl><w:tbl/>"
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.WORD[1:-1]}"><w:body>{inner}</w:body></w:document>')
    (tmp_path / "two.docx").write_bytes(b"no archive")
    (tmp_path / "three.txt").write_text("other")
    files = docx.read_docx(spark, str(tmp_path))
    rows = sorted(tuple(r)[1:] for r in docx.blocks(files).collect())
    assert rows == [(0, "paragraph", "One"), (1, "paragraph", "x y z"), (2, "table", "表格： a | b c")]
    assert [(r["error"] is None, len(r["blocks"])) for r in files.orderBy("path").collect()] == [(True, 3), (False, 0)]
