"""WARC derivatives: metadata and plain-text conversion records, linked to the responses they come from.

Each response gives one metadata record (fields found in its headers and HTML) and one conversion record (its plain text). Both refer to
the response's identifier and keep its target, date, headers and payload digest; their own identifiers are
derived from the response's, so a repeated run gives the same records.

Cases: null payloads and headers are empty ones; a null URL gives the target ''; rows that are equal in id, URL and page give records with equal
identifiers, others do not; an empty table gives no records; other columns are ignored, and columns to keep that have the name of a
record's field are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import html
from lakewarden.llm.common import chunks

HIDDEN = ("script", "style", "template", "noscript")
NAMES = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "source_headers", "block"]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def squeezed(text: str) -> str:
    return " ".join(text.split())


def plain_text(page: str) -> str:
    """One line for each block of the page's body that has text. Of an element that is never closed only the tag goes."""
    out: list[str] = []
    for kind, what, _ in html.tokens(page, (*HIDDEN, "head")):
        out.append(what if kind == "text" else "\n" if what in html.BLOCKS else " " if what in HIDDEN else "")
    lines = (squeezed(line) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def metadata(page: str, headers: str) -> str:
    """The warc-fields of a page: title, language and charset, the response's headers, and the links that are shown."""
    title: list[str] | None = None
    fields: dict[str, str] = {}
    links: list[str] = []
    for kind, what, inside in html.tokens(page, HIDDEN):
        if kind == "text":
            if title is not None:
                title.append(what)
        elif kind == "end":
            if what == "title" and title is not None:
                fields.setdefault("title", squeezed("".join(title)))
                title = None
        elif what == "title":
            title = [] if title is None else title
        elif what == "html" and (lang := html.attributes(inside).get("lang")):
            fields.setdefault("language", squeezed(lang))
        elif what == "meta" and (charset := html.attributes(inside).get("charset")):
            fields.setdefault("charset", squeezed(charset))
        elif what == "a" and (target := html.attributes(inside).get("href")) is not None:
            links.append(squeezed(target))
    found = [(name, fields[name]) for name in ("title", "language", "charset") if name in fields]
    found += [("fetch-header", line) for line in headers.split("\r\n")[1:] if line]
    return "".join(f"{name}: {value}\r\n" for name, value in (*found, *(("outlink", x) for x in links)))


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and a response for each page (url, html): record_id, target_uri, warc_date, headers, payload, payload_digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "html")):
            urls, payloads = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            keys = batch.column("key").to_pylist()
            own = [digest(p.encode("utf-8", "surrogatepass")) for p in payloads]
            heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(p.encode('utf-8', 'surrogatepass'))}\r\n\r\n" for p in payloads]
            ids = [record_id("response", k, u, d) for k, u, d in zip(keys, urls, own, strict=True)]
            texts = [pa.array(x, pa.string()) for x in (ids, urls, [date] * len(urls), heads)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *texts, batch.column("html"), pa.array(own, pa.string())], names=["page_id", "record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    strings = ", ".join(f"{c} string" for c in ("record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    return pages.select("page_id", text("url"), text("html"), key).mapInArrow(run, f"page_id {kind}, {strings}")


def derive(source: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and those of NAMES: two records for each response."""
    keep = [c for c in keep if c.lower() not in NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "payload")):
            owner, rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest"))
            for i, (name, target, date, headers, payload, of) in enumerate(zip(*columns, strict=True)):
                headers, payload = headers or "", payload or ""
                for kind, content, block in (("metadata", "application/warc-fields", metadata(payload, headers)), ("conversion", "text/plain; charset=utf-8", plain_text(payload))):
                    data = block.encode("utf-8", "surrogatepass")
                    owner.append(i)
                    rows.append((kind, record_id(kind, name or ""), name, target or "", date, content, len(data), digest(data), of, headers, block))
            kinds = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 4
            owners = pa.array(owner, pa.int64())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owners) for c in keep), *made], names=[*keep, *NAMES])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    needed = source.select(*keep, *(c for c in ("record_id", "target_uri", "warc_date", "headers", "payload", "payload_digest") if c not in keep))
    return needed.mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} {'bigint' if n == 'content_length' else 'string'}" for n in NAMES))


def serialized(row: dict) -> bytes:
    """A record as one gzip member; members one after the other are a WARC file."""
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["payload_digest"]),
        *(("WARC-Source-HTTP-Header", line) for line in row["source_headers"].split("\r\n")),
        ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"
    return gzip.compress(head.encode() + row["block"].encode("utf-8", "surrogatepass") + b"\r\n\r\n", mtime=0)


def members(records: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and member, each record's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [serialized(row) for row in batch.select(NAMES).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "member"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keep).schema)
    return records.mapInArrow(run, f"{kinds}, member binary")
