"""WARC derivatives: metadata and plain-text conversion records for responses.

``derive`` reads response records as bytes. For each it makes a metadata record
(the HTTP status, header fields, title, link and language of the page) and a
conversion record (its plain text). Both carry WARC-Refers-To with the
response's id and the response's target URI, date and digests; the metadata
record also names the conversion record made beside it. Record ids are name
based UUIDs, so a rerun writes the same records.

Defined results: a record that cannot be parsed yields one row of type
``invalid`` with its reason; a null url or html counts as empty; null ids and
repeated rows keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
SCHEMA = "page_id string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, n_links long, content_length long, record binary, reason string"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|br|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|title|body|head|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; line breaks inside a value are folded to spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (lower-case names) and block of one record; ValueError says what is wrong with it."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("no record header")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or int(fields["content-length"]) > len(rest):
        raise ValueError("a wrong Content-Length")
    return fields, rest[: int(fields["content-length"])]


def page_text(html: str) -> str:
    """Visible text: hidden elements and comments go, block tags part lines, entities are decoded, blanks fold."""
    bare = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", html)))
    lines = (" ".join(line.split()) for line in entities.unescape(bare).split("\n"))
    return "\n".join(line for line in lines if line)


def response_record(page_id: str | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    body = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), url or "")),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(fields, block)


def derive_record(data: bytes) -> list[tuple[str, str, str, str, str, str, int, int, bytes]]:
    """The metadata and the conversion record of one response record."""
    fields, block = read_record(data)
    if fields.get("warc-type") != "response":
        raise ValueError("not a response record")
    head, _, body = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    names = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
    charset = (re.search(r"charset=([\w-]+)", names.get("content-type", ""), re.I) or ["", "utf-8"])[1]
    try:
        html = body.decode(charset, "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    rid, uri, payload = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), digest(body)
    if fields.get("warc-payload-digest", payload) != payload:
        raise ValueError("the payload does not match its digest")
    ids = {kind: record_id(kind, rid) for kind in ("metadata", "conversion")}
    links = [entities.unescape(next(x for x in m if x)) if any(m) else "" for m in _LINK.findall(_HIDDEN.sub(" ", html))]
    title = _TITLE.search(html)
    facts = [
        ("http-status", status),
        *((f"http-{k}", v) for k, v in sorted(names.items())),
        ("title", entities.unescape(title[1]) if title else ""),
        ("lang", (_LANG.search(html) or ["", ""])[1]),
        ("derived-conversion", ids["conversion"]),
        *(("outlink", x) for x in links),
    ]
    blocks = {
        "metadata": ("application/warc-fields", b"".join(f"{k}: {' '.join(v.split())}\r\n".encode("utf-8", "replace") for k, v in facts)),
        "conversion": ("text/plain; charset=utf-8", page_text(html).encode("utf-8", "replace")),
    }
    out = []
    for kind, (mime, made) in blocks.items():
        linked = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", ids[kind]),
            ("WARC-Date", fields.get("warc-date", "")),
            ("WARC-Refers-To", rid),
            ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", fields.get("warc-date", "")),
            ("WARC-Target-URI", uri),
            ("WARC-Source-Payload-Digest", payload),
            ("WARC-Block-Digest", digest(made)),
            ("Content-Type", mime),
        ]
        out.append((kind, ids[kind], rid, uri, payload, digest(made), len(links), len(made), write_record(linked, made)))
    return out


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [response_record(*row) for row in zip(batch["page_id"], batch["url"], batch["html"])]
        yield pd.DataFrame({"page_id": batch["page_id"], "record": made})


def _derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for page, record in zip(batch["page_id"], batch["record"]):
            try:
                rows += [(page, *made, None) for made in derive_record(bytes(record or b""))]
            except ValueError as why:
                rows.append((page, "invalid", *[None] * 5, 0, 0, None, str(why)))
        yield pd.DataFrame(rows, columns=columns)


def pages_to_responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, record), WARC response records as bytes; ids travel as text."""
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(_responses, "page_id string, record binary")


def derive(responses: DataFrame) -> DataFrame:
    """(page_id, record) to the derived records; ``record`` holds the bytes to be written."""
    return responses.select("page_id", "record").mapInPandas(_derive, SCHEMA)


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page, kind, links, record in zip(batch["page_id"], batch["record_type"], batch["n_links"], batch["record"]):
            fields, block = read_record(bytes(record)) if record is not None else ({}, b"")
            rows.append((page, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-source-payload-digest"), fields.get("warc-block-digest"), links, len(block), hashlib.sha256(block).hexdigest()))
        yield pd.DataFrame(rows, columns=["page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_links", "content_length", "block_sha256"])


def digests(derived: DataFrame) -> DataFrame:
    """The linked fields of each derived record, read back from its bytes."""
    kinds = "page_id string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, n_links long, content_length long, block_sha256 string"
    return derived.select("page_id", "record_type", "n_links", "record").mapInPandas(_read_back, kinds).withColumn("page_id", F.col("page_id").cast("long"))
