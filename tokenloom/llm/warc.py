"""WARC (5): derivative builder.

Every response record gives two linked records: ``metadata`` (title, language,
charset, links, and the response's HTTP headers and digests) and ``conversion``
(the page as plain text). Both refer to the response's record id, keep its
target URI and date, and carry digests of their own block. Records are written
as WARC/1.1 files by Spark's text writer (the separator of records is the line
separator) and read back by length, file by file.

Defined cases: a null page is an empty body; a null url gives a record without
target URI; record ids come from page id, url and payload digest, so pages
that repeat in full repeat their record ids; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import as_bytes

DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000
RECORD = "record string"
PARSED = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block string, block_digest string"

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_HREF = re.compile(r"""\bhref\s*=\s*["']?([^"'\s>]+)""", re.I)
_ATTRIBUTE = {n: re.compile(rf"""\b{n}\s*=\s*["']?([^"'\s>]+)""", re.I) for n in ("lang", "charset")}
_HIDDEN = {n: re.compile(rf"</{n}\s*>?", re.I) for n in ("script", "style", "template", "noscript", "title")}
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def convert(page: str) -> tuple[str, dict[str, str], list[str]]:
    """Plain text, fields (title, language, charset) and links, in one pass over the page."""
    out, fields, links, at = [], {}, [], 0
    while True:
        i = page.find("<", at)
        if i < 0:
            out.append(page[at:])
            break
        out.append(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            continue
        tag = _TAG.match(page, i)
        if not tag and not page.startswith(("<!", "<?"), i):
            out.append("<")
            at = i + 1
            continue
        end = page.find(">", i)
        end = len(page) if end < 0 else end
        at = end + 1
        if not tag:
            continue
        name, inner = tag.group(1).lower(), page[tag.end() : end]
        if name in _BREAKS:
            out.append("\n")
        elif name == "a" and (found := _HREF.search(inner)):
            links.append(html.unescape(found.group(1)))
        elif name == "html" and (found := _ATTRIBUTE["lang"].search(inner)):
            fields.setdefault("language", found.group(1))
        elif name == "meta" and (found := _ATTRIBUTE["charset"].search(inner)):
            fields.setdefault("charset", found.group(1))
        if name in _HIDDEN and page[i + 1] != "/":
            stop = _HIDDEN[name].search(page, at)
            if name == "title":
                fields.setdefault("title", " ".join(html.unescape(page[at : stop.start() if stop else len(page)]).split()))
            at = stop.end() if stop else len(page)
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), fields, links


def record(headers: list[tuple[str, str | None]], block: str) -> str:
    """Text of one record without the two line ends that close it."""
    size = len(block.encode())
    return "\r\n".join(["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers if v is not None), f"Content-Length: {size}", "", block])


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of raw pages: page_id, target_uri, date, record_id, http, payload, digests."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                payload = digest(body)
                rows.append((page, url, date, record_id("response", str(page), str(url), payload), http, body.decode(), payload, digest(http.encode() + body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64()), *[pa.array([], pa.string())] * 7], names)

    names = ["page_id", "target_uri", "date", "record_id", "http", "payload", "payload_digest", "block_digest"]
    kinds = ", ".join(f"{n} {'bigint' if n == 'page_id' else 'string'}" for n in names)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(build, kinds)


def derivatives(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response, as record text."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, fields, links = convert(r["payload"] or "")
                status, *lines = r["http"].rstrip("\r\n").split("\r\n")
                meta = [("http-status", status), *((f"http-{k.lower()}", v) for k, _, v in (x.partition(": ") for x in lines))]
                meta += [("response-payload-digest", r["payload_digest"]), ("response-block-digest", r["block_digest"]), *fields.items(), *(("outlink", link) for link in links)]
                block = "".join(f"{k}: {_line(v)}\r\n" for k, v in meta)
                for kind, content, body in (("metadata", "application/warc-fields", block), ("conversion", "text/plain; charset=utf-8", text)):
                    head = [
                        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, r["record_id"])), ("WARC-Refers-To", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]),
                        ("WARC-Block-Digest", digest(body.encode())), ("Content-Type", content), ("Page-ID", None if r["page_id"] is None else str(r["page_id"])),
                    ]
                    out.append(record(head, body))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    return source.mapInArrow(derive, RECORD)


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; a file (bounded by its number of records) is parsed at once."""
    kind = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "block_digest")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in as_bytes(batch.column(0).cast(pa.binary())):
                found = list(parse(content))
                for a in range(0, len(found), 1000):
                    part = found[a : a + 1000]
                    named = {n: [h.get(k) for h, _ in part] for n, k in zip(kind.names, ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest"))}
                    ids = [int(h["Page-ID"]) if "Page-ID" in h else None for h, _ in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), *(pa.array(named[n], pa.string()) for n in kind.names[:5]), pa.array([list(h.items()) for h, _ in part], pa.map_(pa.string(), pa.string())), pa.array([b.decode() for _, b in part], pa.string()), pa.array(named["block_digest"], pa.string())],
                        ["page_id", *kind.names[:5], "headers", "block", "block_digest"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, PARSED)


def build_derivatives(pages: DataFrame) -> DataFrame:
    """Write the derivative records of all pages and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(derivatives(responses(pages)), path)
    return read_warc(spark, path)
