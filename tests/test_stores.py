"""Quarantine, ingest counters, workbooks, graphs, regions and document manifests on small rows."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph, regions
from corpusmill.sources import documents, quarantine, xlsx
from corpusmill.streaming import progress


def test_quarantine(spark, tmp_path):
    lines = ['{"id": 1, "x": "a", "more": 2}', "", "  ", '{"id": 2, "x"', '{"id": "two"}', '{"x": "no id"}', "[1]", "null", '{"id": 3, "x": null}', '"text"', '{"id": null}', '{"id": 4, "x": "é"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines[:6]))
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines[6:]) + "\n")
    version = quarantine.ingest(spark, str(tmp_path / "in"), "id bigint, x string", "id", str(tmp_path / "out"))
    assert sorted(map(tuple, quarantine.good(spark, version).collect())) == [(1, "a"), (3, None), (4, "é")]
    bad = quarantine.quarantined(spark, version).collect()
    assert sorted((r["reason"], r["line"]) for r in bad) == sorted([("not_json", '{"id": 2, "x"'), ("wrong_type", '{"id": "two"}'), ("no_key", '{"x": "no id"}'), ("not_json", "[1]"), ("not_json", "null"), ("not_json", '"text"'), ("no_key", '{"id": null}')])
    assert all(r["file"].endswith(("a.jsonl", "b.jsonl")) for r in bad) and version.facts == {"good": 3.0, "bad": 7.0}


def test_migrated_sessions(spark):
    turn = "struct<turn_id:string,text:string>"
    states = spark.createDataFrame([("u", "a", 5, [("x", "1")]), ("u", "b", None, [("y", "2"), ("z", "3")]), ("u", "c", 0, None), ("u", "d", 1, [])], f"user string, session string, turn_count int, turns array<{turn}>")
    turns = spark.createDataFrame([("u", "a", 2, ("t2", "b")), ("u", "a", 1, ("t1", "a"))], f"user string, session string, seq int, turn {turn}")
    got = {r["session"]: (r["turn_count"], r["last_turn_id"], [t["turn_id"] for t in r["turns"]]) for r in quarantine.migrated_sessions(states, turns).collect()}
    assert got == {"a": (5, "t2", ["t1", "t2"]), "b": (2, "z", ["y", "z"]), "c": (0, None, []), "d": (1, None, [])}


def test_progress(spark, tmp_path):
    """Counters equal the log, over restarts and a batch that is run again; the listener goes on from what is stored."""
    root, src = str(tmp_path / "ingest"), str(tmp_path / "src")
    assert progress.totals(spark, root) == {"batches": 0, "rows_in": 0, "rows_written": 0, "rows_failed": 0}
    listener = None
    for start in (0, 40, 90):
        spark.range(start, start + 30).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id"))).coalesce(1).write.mode("append").json(src)
        if listener:
            spark.streams.removeListener(listener)
        stored = progress.totals(spark, root)
        listener = progress.Progress({"ingest": {"batches": stored["batches"], "rows_in": stored["rows_in"]}})
        spark.streams.addListener(listener)
        query = progress.ingest(spark.readStream.schema("id bigint, v bigint").json(src), root, F.col("v").isNotNull())
        assert query.awaitTermination(60)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    want = {"batches": 3, "rows_in": 90, "rows_written": 81, "rows_failed": 9}
    assert progress.totals(spark, root) == want
    assert progress.rows(spark, root).count() == 81 and sorted(r["id"] for r in progress.rows(spark, root, False).collect()) == [0, 10, 20, 40, 50, 60, 90, 100, 110]
    last = progress.counters(spark, root).orderBy(F.desc("batch")).first()
    assert (last["rows_in"], last["rows_failed"]) == (30, 3)


def _odd_workbook() -> bytes:
    """Shared and rich texts, phonetic runs, gaps, formulas, booleans, styles, 1904 dates and absolute targets."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://r"><workbookPr date1904="1"/><sheets><sheet name="A &amp; B" sheetId="1" r:id="x"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/other/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>one</t></si><si><r><t>ri</t></r><r><t xml:space="preserve">ch </t></r><rPh sb="0"><t>spoken</t></rPh></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;年&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        book.writestr("xl/other/s.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row/><row><c r="B3" s="1"><v>1.5</v></c><c r="AB3" s="2"><v>7</v></c></row><row><c t="b"><v>1</v></c><c t="str"><f>X</f><v>made</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_parts():
    data = _odd_workbook()
    assert xlsx.sheets(data) == ["A & B"]
    rows = list(xlsx.rows(data, "A & B"))
    assert rows[0] == ["one", "rich "] and rows[1][:2] == [None, "1904-01-02 12:00:00"] and rows[1][27] == "7" and len(rows[1]) == 28 and rows[2] == ["true", "made"]
    with pytest.raises(KeyError):
        list(xlsx.rows(data, "none"))


def test_xlsx_equals_csv(spark, tmp_path):
    """One table as CSV and as workbooks of two sheets gives equal rows, by the source and by Spark's own readers."""
    from corpusmill.sources import catalogs

    head = ["标题", " 公布日期 ", "施行日期", "法律法规分类", "n"]
    rows = [["法律甲", datetime.date(2020, 2, 29), datetime.date(1999, 12, 31), "法律", 1], ["乙 <&> \"x\"", None, datetime.date(2021, 1, 1), "", 2.5], ["", None, None, "地方性法规", 3]]
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook({"one": [head, *rows[:2]], "two & more": [head, *rows[2:]]}))
    text = "\n".join(",".join('"' + ("" if x is None else str(x)).replace('"', '""') + '"' for x in r) for r in [head, *rows])
    (tmp_path / "a.csv").write_text("﻿" + text, encoding="utf-8")
    spark.dataSource.register(xlsx.XlsxSource)
    plain = lambda df: sorted(tuple(x or "" for x in r) for r in df.collect())
    source = spark.read.format("xlsx").load(str(tmp_path / "*.xlsx"))
    assert source.columns == [c.strip() for c in head] and source.rdd.getNumPartitions() == 2
    want = plain(catalogs.read_csv(spark, str(tmp_path / "a.csv")))
    assert plain(source) == want == plain(xlsx.read_xlsx(spark, str(tmp_path / "*.xlsx"), source.columns))
    assert spark.read.format("xlsx").option("sheet", "one").load(str(tmp_path / "*.xlsx")).count() == 2


def test_node_link(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "kind": "x"}, {"id": "b"}, {"name": "no id"}],\n "links": [{"source": "a", "target": "b", "w": 1}, {"source": "a"}]}')
    nodes, edges = graph.read_node_link(spark, str(tmp_path / "g.json"))
    assert sorted((r["id"], r["attributes"].get("kind")) for r in nodes.collect()) == [("a", "x"), ("b", None)]
    assert [(r["source"], r["target"]) for r in edges.collect()] == [("a", "b")]
    graph.write_node_link(nodes, edges, str(tmp_path / "out"))
    nodes, edges = graph.read_node_link(spark, str(tmp_path / "out"))
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b"] and [(r["source"], r["target"]) for r in edges.collect()] == [("a", "b")]


def test_neighbourhood(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(150)})
    for hops, degree in ((1, 2), (3, 2), (4, 50)):
        cut = {}
        for a, b in edges:
            cut.setdefault(a, []).append(b)
        want = set()
        for start in (0, 7, 99):
            at = {start: 0}
            last = [start]
            for h in range(1, hops + 1):
                last = sorted({b for a in last for b in cut.get(a, [])[:degree]} - set(at))
                at |= {b: h for b in last}
            want |= {(start, n, h) for n, h in at.items() if h}
        got = graph.neighbourhood(spark.createDataFrame([(0,), (7,), (99,), (7,)], "asked int"), spark.createDataFrame(edges * 2, "source int, target int"), hops, degree)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_regions(spark):
    rng = random.Random(3)
    nodes = [(f"p{i}", None, f"P{i % 2}", "province") for i in range(3)] + [(f"q{i}", f"p{i % 3}" if i else "gone", f"Q{i % 3}", "prefecture") for i in range(7)] + [(f"c{i:02}", f"q{rng.randrange(7)}", f"C{i % 5}", "county") for i in range(40)]
    tree = regions.labelled(spark.createDataFrame(nodes, "id string, parent string, name string, level string"))
    got = {r["id"]: (r["enter"], r["leave"]) for r in tree.collect()}
    parent, name, level = ({n[0]: n[k] for n in nodes} for k in (1, 2, 3))

    def above(i):
        while i in parent:
            yield i
            i = parent[i]

    for a in got:
        for b in got:
            assert (got[a][0] <= got[b][0] < got[a][1]) == (a in above(b))
    assert sorted(x for x, _ in got.values()) == list(range(50))
    requests = [(i, rng.choice(["P0", "P1", None, "", "no"]), rng.choice(["Q0", "Q1", "Q2", None]), rng.choice(["C0", "C4", "C9", None])) for i in range(60)]
    want = {}
    for i, p, q, c in requests:
        for wanted, depth, up in ((c, "county", (p, q)), (q, "prefecture", (p,)), (p, "province", ())):
            fit = [n for n in got if wanted and level[n] == depth and name[n] == wanted and all(not u or u in [name[x] for x in above(n)] for u in up)]
            if fit:
                want[i] = (min(fit), depth)
                break
    found = regions.resolve(spark.createDataFrame(requests, "request int, province string, prefecture string, county string"), tree)
    assert {r["request"]: (r["id"], r["level"]) for r in found.collect()} == want and len(want) > 30


def test_document_manifest(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "root")
    (src / "b").mkdir(parents=True)
    (src / "a.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"old")
    (src / "b" / "a.doc").write_bytes(b"other")
    (src / "x.docx").write_bytes(b"PK\x03\x04same")
    (src / "y.docx").write_bytes(b"PK\x03\x04same")
    (src / "empty").write_bytes(b"-")
    (src / "nothing").write_bytes(b"")
    for i, f in enumerate(sorted(p for p in src.rglob("*") if p.is_file())):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    one = documents.refresh(spark, str(src), root)
    assert one.facts == {"files": 5.0, "read": 5.0, "contents": 4.0}
    stored = {r["name"]: (r["path"].split("/src/")[1], r["kind"], r["copies"], r["legacy"]) for r in documents.store(one.read(spark, "manifest")).collect()}
    assert stored == {"a.doc": ("a.doc", "ole", 2, True), "x.docx": ("x.docx", "zip", 1, False), "y.docx": ("y.docx", "zip", 1, False), "empty": ("empty", "other", 1, False)}
    # a file that looks unchanged isn't read: what it was known to hold stays
    before = (src / "x.docx").stat()
    (src / "x.docx").write_bytes(b"PK\x03\x04SAME")
    os.utime(src / "x.docx", (before.st_mtime, before.st_mtime))
    (src / "y.docx").write_bytes(b"PK\x03\x04newer")
    (src / "moved").write_bytes(b"from elsewhere, with its old time")
    os.utime(src / "moved", (1_600_000_000, 1_600_000_000))
    (src / "empty").unlink()
    two = documents.refresh(spark, str(src), root)
    assert two.facts["files"] == 5.0 and two.facts["read"] == 2.0
    rows = {r["name"]: r for r in two.read(spark, "manifest").collect() if "/b/" not in r["path"]}
    was = {r["name"]: r for r in one.read(spark, "manifest").collect() if "/b/" not in r["path"]}
    assert rows["x.docx"]["digest"] == was["x.docx"]["digest"] and rows["y.docx"]["digest"] != was["y.docx"]["digest"] and "empty" not in rows and rows["moved"]["fresh"]
    assert documents.refresh(spark, str(src), root).facts["read"] == 0.0


def test_places_of_one_name(spark):
    """Very many requests for a name that very many nodes have: their pairs are not made."""
    import time

    own = spark.range(50_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("id"), F.lit("p").alias("parent"), F.lit("same").alias("name"), F.lit("county").alias("level"))
    tree = regions.labelled(own.union(spark.createDataFrame([("p", None, "P", "province")], "id string, parent string, name string, level string")))
    requests = spark.range(50_000).select(F.col("id").alias("request"), F.lit("P").alias("province"), F.lit("").alias("prefecture"), F.lit("same").alias("county"))
    began = time.time()
    counts = lambda own: [tuple(r) for r in regions.resolve(own, tree).groupBy("id").count().collect()]
    assert counts(requests) == [("c000000000", 50_000)] and counts(requests.withColumn("province", F.lit("Q"))) == []
    assert time.time() - began < 60
