"""WARC records and derivatives (operator 7).

Every response record yields a conversion record (plain text of its page) and a metadata record (title, language,
outlinks, sizes, and the response's status line and HTTP headers).  Both refer to the response by its identifier, keep its
target URI, date, digests, address and concurrent records, and have record identifiers of their own that depend
only on their content, so a rerun writes the same bytes.  ``read_files`` and ``write_files`` go from and to WARC files, gzipped by record or not.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loresift.llm.common import need, session, small_batches

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_EOL = "\r\n"
_HIDDEN = re.compile(r"<(script|style|template|noscript|head)\b|<!--", re.I)
_HIDDEN_END = re.compile(r"</(script|style|template|noscript|head)\s*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|thead|tbody|article|section|header|footer|nav|main|aside|pre|blockquote|form|figure|figcaption|body|html|title)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>|<\?[^<>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title", re.I)
_LANG = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)


@dataclass
class Record:
    """Headers in order and the block of bytes."""

    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        """The first header of that name; case doesn't matter."""
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def serialise(r: Record) -> bytes:
    return (VERSION + _EOL + "".join(f"{k}: {v}{_EOL}" for k, v in r.headers) + _EOL).encode() + r.block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[Record]:
    """Records of an uncompressed WARC; folded header lines are joined.

    A record without a usable Content-Length ends the reading with a ``ValueError``.
    """
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in data[at:end].decode("utf-8", "replace").split(_EOL)[1:]:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
            elif ":" in line:
                k, v = line.split(":", 1)
                headers.append((k.strip(), v.strip()))
        r = Record(headers)
        size = r.get("Content-Length")
        if size is None or not size.isdigit() or end + 4 + int(size) > len(data):
            raise ValueError(f"bad Content-Length at byte {at}")
        at = end + 4 + int(size)
        r.block = data[end + 4 : at]
        yield r


def unpacked(data: bytes) -> bytes:
    """The bytes of a WARC file that is gzipped by record, as a whole, or not at all."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(wbits=31)
        out.append(z.decompress(data[at:]) if at == 0 else z.decompress(memoryview(data)[at:]))
        if not z.eof:
            raise ValueError("a gzip member is cut short")
        at = len(data) - len(z.unused_data)
    return b"".join(out)


def response(url: str, page: str, date: str = DATE, key: object = "") -> Record:
    """A response record of a page, with the HTTP message as its block."""
    payload = page.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: {len(payload)}{_EOL}{_EOL}".encode()
    block = http + payload
    return Record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", key, url, digest(payload))),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
        block,
    )


def payload(r: Record) -> str:
    """The decoded body of a response's HTTP message (all of the block, if there is no HTTP header)."""
    head, sep, body = r.block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        head, body = b"", r.block
    m = _CHARSET.search(head) or _CHARSET.search(body[:1024])
    try:
        return body.decode(m[1].decode("ascii") if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def visible(page: str) -> str:
    """The page without scripts, styles, templates, its head and comments; one that is never closed hides the rest, but for a head.

    Every end is looked for once, so a page of unclosed tags takes no longer than others.
    """
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _HIDDEN_END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    out, at = [], 0
    for m in _HIDDEN.finditer(page):
        if m.start() < at:
            continue
        if m[1] is None:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            opened = page.find(">", m.end())
            if opened < 0:
                break
            closing = ends.get(m[1].lower(), [])
            k = bisect_left(closing, (opened + 1, 0))
            if k < len(closing):
                end = closing[k][1]
            elif m[1].lower() == "head":
                continue
            else:
                end = len(page)
        out += [page[at : m.start()], " "]
        at = end
    return "".join([*out, page[at:]])


def _squeezed(text: str) -> str:
    page = _TAG.sub(" ", _BLOCK.sub("\n", re.sub(r"[\r\n]+", " ", text)))
    lines = (" ".join(html.unescape(x).split()) for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    """Visible text: block elements break lines, white space is squeezed, entities are decoded once."""
    return _squeezed(visible(page))


def title_of(page: str) -> str:
    start = _TITLE.search(page)
    end = _TITLE_END.search(page, start.end()) if start else None
    return " ".join(html.unescape(page[start.end() : end.start()]).split()) if end else ""


def http_head(r: Record) -> tuple[str, list[tuple[str, str]]]:
    """The status line and headers of a response's HTTP message; empty without one."""
    head, sep, _ = r.block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", []
    status, *lines = head.decode("utf-8", "replace").split(_EOL)
    return status, [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]


#: Headers of the response that derivatives keep under a name of their own.
KEPT = {"WARC-Payload-Digest": "WARC-Source-Payload-Digest", "WARC-Block-Digest": "WARC-Source-Block-Digest", "WARC-IP-Address": "WARC-IP-Address", "WARC-Concurrent-To": "WARC-Source-Concurrent-To", "WARC-Identified-Payload-Type": "WARC-Source-Identified-Payload-Type"}


def derive(r: Record) -> list[Record]:
    """The metadata and conversion records of a response; nothing for other records."""
    if (r.get("WARC-Type") or "").lower() != "response":
        return []
    page, url, source = payload(r), r.get("WARC-Target-URI") or "", r.get("WARC-Record-ID") or ""
    lang = _LANG.search(page)
    seen = visible(page)
    links: dict[str, None] = {}
    for m in _HREF.findall(seen):
        ref = html.unescape(next((x for x in m if x), ""))
        try:
            link = urljoin(url, ref.strip())
        except ValueError:  # an address that can't be resolved is kept as it is
            link = ref.strip()
        if link:
            links[re.sub(r"[\r\n]+", "", link)] = None
    text = _squeezed(seen).encode("utf-8", "replace")
    status, http = http_head(r)
    facts = [("title", title_of(page)), ("language", lang[1].lower() if lang else ""), ("text-bytes", str(len(text)))]
    facts += ([("http-status", status)] if status else []) + [("http-header", f"{k}: {v}") for k, v in http]
    body = "".join(f"{k}: {v}{_EOL}" for k, v in facts + [("outlink", x) for x in links]).encode("utf-8", "replace")
    kept = [(KEPT[name], v) for name in KEPT for k, v in r.headers if k.lower() == name.lower()]
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", body), ("conversion", "text/plain; charset=utf-8", text)):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source, digest(block))), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url)]
        headers += [("WARC-Refers-To-Date", r.get("WARC-Date") or ""), ("WARC-Date", r.get("WARC-Date") or ""), ("WARC-Target-URI", url), *kept]
        headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
        out.append(Record(headers, block))
    return out


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, record binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def derivatives(pages: DataFrame) -> DataFrame:
    """Two serialised records (metadata, conversion) for every row of ``pages(page_id, url, html)``.

    The page is wrapped as a response record first, serialised and parsed again, so the result is what a file
    of such records would give.  Null or empty pages give an empty text, null addresses an empty target; null
    ids stay; repeated rows give repeated records with the same identifiers.  Extra columns are ignored.  Pages of any
    length are read whole, in time that grows with their length.
    """
    small_batches(session(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in parse(serialise(response(re.sub(r"[\r\n]", "", url or ""), page or "", key=key))):
                    for d in derive(r):
                        rows.append((key, d.get("WARC-Type"), d.get("WARC-Record-ID"), d.get("WARC-Refers-To"), d.get("WARC-Target-URI"), d.get("WARC-Source-Payload-Digest"), d.get("WARC-Block-Digest"), len(d.block), serialise(d)))
            if rows:
                types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    columns = need(pages, ["page_id", "url", "html"])
    return columns.withColumn("page_id", columns["page_id"].cast("long")).mapInArrow(run, SCHEMA)


FILE_SCHEMA = "path string, seq long, warc_type string, record_id string, record binary"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``FILE_SCHEMA``: every record of the WARC files in ``path``, gzipped or not, serialised; a damaged file fails the job."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(name, i, r.get("WARC-Type"), r.get("WARC-Record-ID"), serialise(r)) for i, r in enumerate(parse(unpacked(data.as_py())))]
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in FILE_SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FILE_SCHEMA)


def derived(records: DataFrame) -> DataFrame:
    """``(record_type, record_id, refers_to, record)`` of the derivatives of all responses among ``records(record)``; null records have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d.get("WARC-Type"), d.get("WARC-Record-ID"), d.get("WARC-Refers-To"), serialise(d)) for x in b.column(0).to_pylist() if x for r in parse(x) for d in derive(r)]
            if rows:
                types = (pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["record_type", "record_id", "refers_to", "record"])

    return need(records, ["record"]).mapInArrow(run, "record_type string, record_id string, refers_to string, record binary")


def write_files(records: DataFrame, folder: str) -> list[str]:
    """The names of new files ``part-N.warc.gz`` in ``folder``, one for each partition of ``records(record)`` that has any; a gzip member for each record.

    The folder must be one that all executors mount.  A file appears at once when it is whole, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        part, any_row = os.path.join(folder, f".{name}.{uuid.uuid4().hex}"), False
        os.makedirs(folder, exist_ok=True)
        with open(part, "wb") as f:
            for b in batches:
                for x in b.column(0).to_pylist():
                    if x:
                        f.write(gzip.compress(x, mtime=0))
                        any_row = True
        if any_row:
            os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])
        else:
            os.unlink(part)

    return sorted(r["name"] for r in need(records, ["record"]).mapInArrow(run, "name string").collect())  # one name for each partition
