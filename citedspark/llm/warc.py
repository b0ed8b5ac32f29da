"""WARC derivatives: metadata and plain-text conversion records linked to responses.

`responses` writes pages as WARC/1.1 response records (an HTTP message with the page as its
payload); `derived` reads any such records and makes two new ones of each: a metadata record and
a conversion record with the page's visible text. Both refer to the response by its record id,
carry its target, date and IP address where it has them, keep the source's headers, and have
digests of their own blocks.

Record ids are made from what a record says, so a run gives the same records again.

Nulls, ties, repeats: a null page is an empty payload; a null url gives a record without a
target. A record that is no response, or cannot be read, gives one row with `problem` set and no
block. Rows that repeat are each converted. Only `page_id`, `url` and `html` of pages are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import slices

# Fixed values.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html"
    "|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
)

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BLOCK_TAGS})\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/a-zA-Z?][^>]*>")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    """A labelled digest, as WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: bytes) -> str:
    """A urn for a record that says just this."""
    mark = hashlib.sha256(b"\0".join(parts)).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=mark[:16], version=5)}>"


def visible_text(page: str) -> str:
    """The text that a reader of the page sees: a line for each block, blanks made single."""
    text = _HIDDEN.sub(" ", page)
    text = _TAG.sub("", _BREAK.sub("\n", text))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def written(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, an empty line, the block and two line ends."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of a record; ValueError if it is none."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise ValueError("no record")
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        name = name.strip().lower()
        headers[name] = value.strip()
    size = int(headers.get("content-length", "-1"))
    if size < 0 or len(rest) < size:
        raise ValueError("a block shorter than its length")
    return headers, rest[:size]


def _response(url: str | None, page: str | None) -> bytes:
    body = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(b"response", (url or "").encode(), block))]
    headers += [("WARC-Date", DATE), *([("WARC-Target-URI", url.replace("\r", "").replace("\n", ""))] if url else [])]
    headers += [("Content-Type", "application/http; msgtype=response")]
    headers += [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))]
    return written(headers, block)


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            records = [
                _response(url, page)
                for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.record_batch([batch.column(0), pa.array(records, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, record binary")


def _http(block: bytes) -> tuple[str, list[str], bytes]:
    """(status line, header lines, payload) of an HTTP message."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        raise ValueError("no HTTP message")
    return lines[0], lines[1:], payload


def _derived(record: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    headers, block = read(record)
    if headers.get("warc-type") != "response":
        raise ValueError("no response")
    status, lines, payload = _http(block)
    source = headers.get("warc-record-id", "")
    stated = headers.get("warc-payload-digest")
    found = digest(payload)
    shared = [("WARC-Refers-To", source)]
    for name in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address"):
        if name.lower() in headers:
            shared.append((name if name != "WARC-Date" else "WARC-Refers-To-Date", headers[name.lower()]))
    charset = re.search(r"charset=[\"']?([A-Za-z0-9_.:-]+)", "\n".join(lines), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", errors="replace")
    except LookupError:
        page = payload.decode("utf-8", errors="replace")
    fields = [f"http-status: {status}", *(f"http-header: {line}" for line in lines)]
    fields += [f"warc-header: {name}: {value}" for name, value in headers.items()]
    fields += [f"payload-digest: {found}", f"payload-digest-agrees: {stated is None or stated == found}".lower()]
    out = []
    for kind, type_, body in (
        ("metadata", "application/warc-fields", "\r\n".join([*fields, ""]).encode()),
        ("conversion", "text/plain; charset=utf-8", visible_text(page).encode()),
    ):
        own = record_id(kind.encode(), source.encode(), body)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", headers.get("warc-date", DATE)), *shared]
        head += [("Content-Type", type_), ("WARC-Block-Digest", digest(body))]
        if kind == "conversion":
            head.append(("WARC-Source-Payload-Digest", stated or found))
        out.append(
            {
                "kind": kind, "record_id": own, "refers_to": source, "target_uri": headers.get("warc-target-uri"),
                "block_digest": digest(body), "payload_digest": stated or found, "block": body,
                "record": written(head, body), "problem": None,
            }
        )
    return out


_ROW = [
    ("page_id", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("block", pa.binary()),
    ("record", pa.binary()), ("problem", pa.string()),
]


def _deriving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_ROW)
    for batch in slices(batches, 1):
        rows = []
        for page_id, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found = _derived(record or b"")
            except (ValueError, UnicodeDecodeError) as problem:
                found = [{name: None for name, _ in _ROW} | {"problem": str(problem)}]
            rows += [each | {"page_id": page_id} for each in found]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def derived(records: DataFrame) -> DataFrame:
    """The derived records of every response record, with what links them: two rows a response."""
    return records.select("page_id", "record").mapInArrow(
        _deriving,
        "page_id long, kind string, record_id string, refers_to string, target_uri string, block_digest string, "
        "payload_digest string, block binary, record binary, problem string",
    )


def write_segments(records: DataFrame, path: str) -> None:
    """The records as files of a table: one row a record, ordered by source inside each file."""
    records.where(F.col("record").isNotNull()).select("refers_to", "kind", "record").sortWithinPartitions(
        "refers_to", F.desc("kind")
    ).write.mode("errorifexists").parquet(path)
