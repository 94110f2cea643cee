"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives one `metadata` record (application/warc-fields: the source's
status line, its HTTP headers, its digests and what was found) and one
`conversion` record (text/plain). Both name the response in WARC-Refers-To, with
its URI and date in WARC-Refers-To-Target-URI and -Date, carry its payload digest
unchanged, and have a block digest of their own. Record ids are name-based UUIDs
of the response's id and the kind, so a repeated run gives the same records.

A payload is unpacked first: chunked Transfer-Encoding, then gzip, deflate and zstd
Content-Encoding, as named. A response whose payload is no text (images, archives,
other encodings, broken ones) has a metadata record that says so and no conversion
record. Of a WARC file, what is no whole record (a foreign line, a Content-Length
that is missing or no number, a block that is cut short, a broken gzip member) gives one row of
type ``error`` with the file, the place and the reason, and reading goes on at the
next line that begins a record; header bytes that are not UTF-8 are replaced.

Pages become responses by `response()`: null urls give `about:blank`, null html an
empty payload. Two rows alike in page_id, url and html give records with equal
ids. Texts of any length are one record; an empty table gives no record; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._html import visible_text
from ._memory import mapped
from ._store import table

CRLF = b"\r\n"
#: Date of the responses that pages stand for: the pages have none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in self.headers)])
        return head + CRLF * 2 + self.block + CRLF * 2


@dataclass
class Malformed:
    """What a file has in the place of a record."""

    at: int
    reason: str


def _headers(stream: io.BufferedIOBase) -> list[tuple[str, str]]:
    headers: list[tuple[str, str]] = []
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and headers:  # a folded line
            headers[-1] = headers[-1][0], headers[-1][1] + " " + text.strip()
        else:
            key, _, value = text.partition(":")
            headers.append((key.strip(), value.strip()))
    return headers


class _Members(io.RawIOBase):
    """The unpacked bytes of gzip members, as far as they are whole; ``error`` says what ended them early."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.z, self.error, self.given = data, 0, b"", None, "", 0

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.given

    def _more(self) -> bytes:
        self.at += 1 << 16
        return self.data[self.at - (1 << 16) : self.at]

    def readinto(self, target: memoryview) -> int:
        while not self.error:
            if self.z is None:
                self.held = self.held or self._more()
                if not self.held:
                    return 0
                self.z = zlib.decompressobj(31)
            try:
                out = self.z.decompress(self.held, len(target))
            except zlib.error as e:
                self.error = str(e)
                return 0
            self.held = self.z.unconsumed_tail
            if self.z.eof:
                self.held, self.z = self.z.unused_data, None
            elif not out and not self.held:
                self.held = self._more()
                if not self.held:
                    self.error = "the file ends within a member"
            if out:
                target[: len(out)] = out
                self.given += len(out)
                return len(out)
        return 0


def scan(data: bytes) -> Iterator[Record | Malformed]:
    """The records of a WARC file, plain or with one gzip member a record, one after another (only one is held unpacked), and what is none."""
    members = _Members(data) if data[:2] == b"\x1f\x8b" else None
    stream = io.BufferedReader(members) if members else io.BytesIO(data)
    foreign = False
    while line := stream.readline():
        at = stream.tell() - len(line)
        if not line.startswith(b"WARC/"):
            if line.strip() and not foreign:
                foreign = True
                yield Malformed(at, "no record begins here")
            continue
        foreign = False
        record = Record(_headers(stream), b"")
        size = record.get("Content-Length") or ""
        if not size.isascii() or not size.isdigit():
            foreign = True  # its block is passed over up to the next record
            yield Malformed(at, f"Content-Length {size[:40]!r}")
            continue
        record.block = stream.read(int(size))
        if len(record.block) < int(size):
            yield Malformed(at, f"{len(record.block)} of {size} bytes")
        else:
            yield record
    if members and members.error:
        yield Malformed(members.given, f"gzip: {members.error}")


def parse(data: bytes) -> Iterator[Record]:
    """The records of a file that has nothing else; else a ValueError."""
    for found in scan(data):
        if isinstance(found, Malformed):
            raise ValueError(f"{found.reason}, at {found.at}")
        yield found


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("chunks without an end")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 1 : end + 1 + size])
        if len(out[-1]) < size:
            raise ValueError("a chunk is cut short")
        at = end + 1 + size
        at += 2 if data[at : at + 2] == CRLF else 1


def _inflated(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -zlib.MAX_WBITS)


_CODINGS: dict[str, Callable[[bytes], bytes]] = {
    "gzip": gzip.decompress, "x-gzip": gzip.decompress, "deflate": _inflated, "zstd": lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x), "identity": lambda x: x, "chunked": _unchunked,
}


def unpacked(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings; a ValueError if one is unknown or broken. Archives that have undone chunks keep the header: a body that is no chunks is left as it is."""
    named = lambda key: [x.strip().lower() for k, v in headers if k.lower() == key for x in v.split(",") if x.strip()]
    for coding in reversed(named("transfer-encoding")):
        if coding == "chunked" and not re.match(rb"[0-9A-Fa-f]+[ \t]*(;[^\n]*)?\r?\n", payload):
            continue
        payload = _decoded(coding, payload)
    for coding in reversed(named("content-encoding")):
        payload = _decoded(coding, payload)
    return payload


def _decoded(coding: str, payload: bytes) -> bytes:
    if coding not in _CODINGS:
        raise ValueError(f"encoding {coding}")
    try:
        return _CODINGS[coding](payload)
    except (ValueError, EOFError, OSError, zlib.error, zstandard.ZstdError) as e:
        raise ValueError(f"{coding}: {e}") from None


_TEXTS = re.compile(r"text/|application/(?:[^;]*\+)?(?:xml|json|javascript|ecmascript|x-javascript|rtf)\b", re.IGNORECASE)


def is_text(kind: str, payload: bytes) -> bool:
    """By the type; without a type, if the first bytes hold no zero byte."""
    return bool(_TEXTS.match(kind)) if kind else b"\0" not in payload[:1024]


def _clean(value: str) -> str:
    return " ".join(value.split())


def response(page_id: int | None, url: str | None, page: str | None) -> Record:
    payload = (page or "").encode()
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()])
    block = http + CRLF * 2 + payload
    uri = _clean(url or "") or "about:blank"
    number = uuid.uuid5(_SPACE, f"{page_id} {uri} {digest(payload)}")
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(CRLF * 2)
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)], payload


def derive(source: Record) -> tuple[Record, ...]:
    """The metadata and, if the payload is text, the conversion record of a response."""
    status, headers, payload = http_parts(source.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    id_, uri, date = (source.get(k) or "" for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    fields = [("source-record-id", id_), ("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", source.get("WARC-Payload-Digest") or digest(payload)), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block))]
    text = None
    try:
        body = unpacked(payload, headers)
    except ValueError as e:
        fields.append(("no-conversion", str(e)))
    else:
        if is_text(kind, body):
            charset = (m[1] if (m := _CHARSET.search(kind)) else "utf-8").lower()
            try:
                page = body.decode(charset, "replace")
            except (LookupError, UnicodeError):  # no such charset, or none of texts
                charset, page = "utf-8", body.decode("utf-8", "replace")
            text = (visible_text(page) if "html" in kind.lower() or not kind else page).encode()
            fields += [("charset", charset), ("text-digest", digest(text)), ("text-length", str(len(text)))]
        else:
            fields.append(("no-conversion", f"type {kind or 'unknown'}"))

    def made(kind: str, content_type: str, block: bytes) -> Record:
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{id_} {kind}')}>"
        return Record([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", id_), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Payload-Digest", source.get("WARC-Payload-Digest") or digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))], block)

    metadata = made("metadata", "application/warc-fields", b"".join(f"{k}: {_clean(v)}".encode() + CRLF for k, v in fields))
    return (metadata,) if text is None else (metadata, made("conversion", "text/plain; charset=utf-8", text))


SCHEMA = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_type string, content_length bigint, record binary"
_HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type")


def _derive(kinds: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids, urls, pages = batch.columns
            for at in range(0, len(ids), 256):
                rows = []
                for i in range(at, min(at + 256, len(ids))):
                    source = response(ids[i].as_py(), urls[i].as_py(), pages[i].as_py())
                    rows += [(ids[i].as_py(), r) for r in (source, *derive(source)) if r.get("WARC-Type") in kinds]
                columns = [pa.array([i for i, _ in rows], pa.int64()), *(pa.array([r.get(h) for _, r in rows], pa.string()) for h in _HEADERS), pa.array([len(r.block) for _, r in rows], pa.int64()), pa.array([r.to_bytes() for _, r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def records(pages: DataFrame, kinds: tuple[str, ...] = ("metadata", "conversion")) -> DataFrame:
    """One row a record: its main headers and its bytes. One pass, no shuffle."""
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return mapped(own, _derive(kinds), SCHEMA)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for content, path in zip(batch.column(0), batch.column(1).to_pylist()):
            for source in scan(content.as_py() or b""):
                if isinstance(source, Malformed):
                    reason = f"{source.reason}, at {source.at}".encode()
                    row = {"record_type": "error", "target_uri": path, "content_length": len(reason), "record": reason}
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], pa.int64() if n in ("page_id", "content_length") else pa.binary() if n == "record" else pa.string()) for n in names], names=names)
                    continue
                if (source.get("WARC-Type") or "").lower() != "response":
                    continue
                found = derive(source)
                columns = [pa.nulls(len(found), pa.int64()), *(pa.array([r.get(h) for r in found], pa.string()) for h in _HEADERS), pa.array([len(r.block) for r in found], pa.int64()), pa.array([r.to_bytes() for r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """As ``records``, of the response records of the WARC files at ``path`` (plain or gzip by member; at most 2 GB a file as stored), and error rows; page_id is null."""
    return mapped(spark.read.format("binaryFile").load(path).select("content", "path"), _files, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(table(spark, sf_dir, "pages"))
    return found.withColumn("record_sha256", F.sha2("record", 256))
