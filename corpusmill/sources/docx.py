"""Word documents: paragraphs and tables in order, from a scan of whole files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The XML name space of the format, the heading of a table, the banner of converted files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TABLE = "表格：\n"
BANNER = "Created with an evaluation copy of Aspose.Words."

_BLOCKS = "array<struct<kind:string,cells:array<array<string>>>>"


def _raw(node: ElementTree.Element) -> str:
    sign = {WORD + "tab": " ", WORD + "br": "\n"}
    return "".join((x.text or "") if x.tag == WORD + "t" else sign.get(x.tag, "") for x in node.iter())


def body(content: bytes) -> list[dict]:
    """The blocks of a file's body: kind, and cells by row (one cell for a paragraph)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        top = ElementTree.fromstring(archive.read("word/document.xml")).find(WORD + "body")
    found = []
    for node in () if top is None else top:
        if node.tag == WORD + "p":
            found.append({"kind": "paragraph", "cells": [[_raw(node)]]})
        elif node.tag == WORD + "tbl":
            found.append({"kind": "table", "cells": [[_raw(c) for c in row.findall(WORD + "tc")] for row in node.findall(WORD + "tr")]})
    return found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            try:
                blocks, error = body(content.as_py() or b""), None
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                blocks, error = [], f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([error], pa.string()), pa.array([blocks], kind)], names=["path", "error", "blocks"])


def _text(block: Column) -> Column:
    rows = F.transform(block["cells"], lambda row: F.array_join(F.filter(F.transform(row, T.clean_text), lambda c: c != ""), " | "))
    joined = F.array_join(F.filter(rows, lambda r: r != ""), "\n")
    return F.when((block["kind"] == "table") & (joined != ""), T.clean_text(F.concat(F.lit(TABLE), joined))).otherwise(joined)


def read_docx(spark: SparkSession, path: str, pattern: str = "*.doc[xm]") -> DataFrame:
    """path, error, blocks (kind, text): one row for each file; a file that cannot be read has its error and no blocks.

    Blocks without text and the converter's banner are left out. Cells of a table row are joined by bars.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInArrow(_parse, f"path string, error string, blocks {_BLOCKS}")
    texts = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), _text(b).alias("text")))
    return found.select("path", "error", F.filter(texts, lambda b: (b["text"] != "") & ~((b["kind"] == "paragraph") & b["text"].startswith(BANNER))).alias("blocks"))


def blocks(files: DataFrame) -> DataFrame:
    """path, ord (from 0), kind, text: one row for each block."""
    return files.select("path", F.posexplode("blocks").alias("ord", "block")).select("path", "ord", "block.kind", "block.text")
