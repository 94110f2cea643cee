"""XLSX workbooks as tables: a data source with a partition for each file and sheet, and the same reading over any store.

A workbook is a zip of XML parts. Texts are shared or inline, numbers are as written; a number
whose style is a date format becomes a date or a time. Rows are read as a stream of XML,
so a sheet is never held as a tree. The first row names the columns.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from glob import glob
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Number formats of the standard that are dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_CELL = re.compile(r"([A-Z]+)")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> str:
    """The text of a cell or shared string; what is read aloud for it is left out."""
    return "".join(t.text or "" for run in element for t in ([run] if _name(run.tag) == "t" else [x for x in run if _name(x.tag) == "t"] if _name(run.tag) == "r" else []))


def _parts(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    if name not in book.namelist():
        return
    with book.open(name) as part:
        for _, e in ElementTree.iterparse(part):
            if _name(e.tag) == wanted:
                yield e
                e.clear()


def sheets(content: bytes) -> list[str]:
    """The names of a workbook's sheets, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return [e.get("name") for e in _parts(book, "xl/workbook.xml", "sheet")]


def _path(book: zipfile.ZipFile, sheet: str) -> str:
    targets = {e.get("Id"): e.get("Target") for e in _parts(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    for e in _parts(book, "xl/workbook.xml", "sheet"):
        if e.get("name") == sheet:
            key = next(v for k, v in e.attrib.items() if _name(k) == "id")
            return posixpath.normpath(posixpath.join("xl", targets[key])).lstrip("/") if not targets[key].startswith("/") else targets[key][1:]
    raise KeyError(sheet)


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    with book.open("xl/styles.xml") as part:
        tree = ElementTree.parse(part).getroot()
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or "") for e in tree.iter() if _name(e.tag) == "numFmt"}
    styles = next((e for e in tree if _name(e.tag) == "cellXfs"), [])
    return [(n := int(x.get("numFmtId") or 0)) in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(n, ""), re.IGNORECASE)) for x in styles]


def _date(number: float, since_1904: bool) -> str:
    moment = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    moment += datetime.timedelta(seconds=round(number * 86_400))
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(" ")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts; a cell that is not there is null. Rows without a cell are skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(e) for e in _parts(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        since_1904 = any(e.get("date1904") in ("1", "true") for e in _parts(book, "xl/workbook.xml", "workbookPr"))
        for row in _parts(book, _path(book, sheet), "row"):
            own: list[str | None] = []
            for cell in row:
                at = _column(m[1]) if (m := _CELL.match(cell.get("r") or "")) else len(own)
                own += [None] * (at + 1 - len(own))
                kind, style = cell.get("t") or "n", int(cell.get("s") or 0)
                value = next((x.text for x in cell if _name(x.tag) == "v"), None)
                if kind == "inlineStr":
                    own[at] = next((_texts(x) for x in cell if _name(x.tag) == "is"), None)
                elif value is None:
                    continue
                elif kind == "s":
                    own[at] = shared[int(value)]
                elif kind == "n" and style < len(dates) and dates[style]:
                    own[at] = _date(float(value), since_1904)
                else:
                    own[at] = {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
            if any(x is not None for x in own):
                yield own


def table(content: bytes, sheet: str, width: int) -> Iterator[tuple]:
    """The rows after the heading, each of ``width`` cells."""
    found = rows(content, sheet)
    next(found, None)
    for r in found:
        yield tuple((r + [None] * width)[:width])


def _heading(content: bytes, sheet: str) -> list[str]:
    return [(c or "").strip() or f"_c{i}" for i, c in enumerate(next(rows(content, sheet), []))]


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: all sheets of the workbooks at a path or glob that driver and executors can open; ``sheet`` names one."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _found(self) -> list[tuple[str, str]]:
        found = []
        for path in sorted(glob(self.options["path"])):
            with open(path, "rb") as file:
                names = sheets(file.read())
            found += [(path, n) for n in names if self.options.get("sheet") in (None, n)]
        return found

    def schema(self) -> StructType:
        found = self._found()
        if not found:
            raise FileNotFoundError(self.options["path"])
        with open(found[0][0], "rb") as file:
            return StructType([StructField(c, StringType()) for c in _heading(file.read(), found[0][1])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._found(), len(schema))


class _Reader(DataSourceReader):
    def __init__(self, found: list[tuple[str, str]], width: int):
        self.found, self.width = found, width

    def partitions(self) -> list[InputPartition]:
        return [_Part(*x) for x in self.found]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            yield from table(file.read(), partition.sheet, self.width)


def unpack(workbooks: DataFrame, columns: list[str], content: str = "content") -> DataFrame:
    """The rows of workbooks in a binary column: each sheet's cells below its heading, as texts in ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for sheet in sheets(data) if data else ():
                    held: list[tuple] = []
                    for row in table(data, sheet, len(columns)):
                        held.append(row)
                        if len(held) == 10_000:
                            yield made(held)
                            held = []
                    yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(len(columns))], names=columns)

    return workbooks.select(content).mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As the data source, through Spark's own readers: for stores that only these reach."""
    return unpack(spark.read.format("binaryFile").load(path), columns)


def workbook(sheets_: dict[str, list[list[object]]]) -> bytes:
    """A workbook of sheets with rows of texts, numbers and dates; null cells are left out."""
    letters = lambda n: (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)
    main, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(at: str, x: object) -> str:
        if isinstance(x, datetime.date):
            return f'<c r="{at}" s="1"><v>{(x - datetime.date(1899, 12, 30)).days}</v></c>'
        if isinstance(x, (int, float)):
            return f'<c r="{at}"><v>{x!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = list(sheets_)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}relationships"><Relationship Id="r0" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, n in enumerate(names, 1):
            body = "".join(f'<row r="{k}">' + "".join(cell(f"{letters(j)}{k}", x) for j, x in enumerate(row) if x is not None) + "</row>" for k, row in enumerate(sheets_[n], 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def pack(df: DataFrame, rows_each: int = 5_000, sheet: str = "rows") -> DataFrame:
    """(content): workbooks of up to ``rows_each`` rows of each partition, with a heading; dates stay dates, other values are as Spark hands them to Python."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_each):
                part = batch.slice(at, rows_each)
                data = workbook({sheet: [columns, *map(list, zip(*(c.to_pylist() for c in part.columns)))]})
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


def normalised(df: DataFrame) -> DataFrame:
    """All columns as texts, dates as their ISO form: what a workbook of ``df`` gives back."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
