"""Media columns: interleaved document sequences whose media are resolved by digest.

parse() turns HTML into ordered items, text or a media reference, each with its position; a reference has the digest it names
and its caption. A media store has one row for each digest. resolve() joins the references to the store by digest and
puts what it finds back in place. Payloads here are stored as 8-bit grey PNG images, 24 samples wide, which is lossless.

Cases: null HTML or text is the empty one; a reference without a digest or with an unknown one keeps its place
and resolves to null; equal payloads are stored once; repeated rows are parsed each; an empty table gives no rows; a caption belongs to the media of
the innermost figure around it, and outside of figures it is text; other columns are ignored, and columns to keep that are named items are left out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import html
from lakewarden.llm.common import chunks

WIDTH = 24
#: Payloads are filled up to a positive multiple of this with FILL, which no UTF-8 text contains.
UNIT, FILL = 576, b"\xff"
SCHEME = "urn:sha256:"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"


class _Items:
    """Ordered text and media items of a page. A figure's caption goes to all media inside it when the figure ends; a caption or figure that is never closed ends with the figure or page around it."""

    MEDIA = ("img", "audio", "video", "source")

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figures: list[tuple[int, str | None]] = []  # of each open figure its first item, and its caption
        self.caption: list[str] | None = None
        self.captioned = 0  # the number of the figure whose caption is open
        self.captions: list[tuple[int, int, str]] = []  # of each figure that has ended its first item, its end and its caption

    @staticmethod
    def line(words: list[str]) -> str:
        return re.sub(r"\s+", " ", "".join(words)).strip()

    def flush(self) -> None:
        if text := self.line(self.words):
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def end_caption(self) -> None:
        if self.caption is not None:
            self.figures[self.captioned] = (self.figures[self.captioned][0], self.line(self.caption))
            self.caption = None

    def end_figure(self) -> None:
        if self.caption is not None and self.captioned == len(self.figures) - 1:
            self.end_caption()
        first, caption = self.figures.pop()
        if caption is not None:
            self.captions.append((first, len(self.items), caption))

    def hand_out(self) -> None:
        """Captions go to the media of their figures; an outer figure ends later and its caption holds for all inside it."""
        covered = len(self.items)
        for first, end, caption in reversed(self.captions):
            if end <= covered:  # else inside of one that has been handed out
                for item in self.items[first:end]:
                    item["caption"] = caption if item["kind"] == "media" else None
                covered = first

    def start(self, tag: str, inside: str) -> None:
        if tag in self.MEDIA:
            values = html.attributes(inside)
            if source := values.get("src") or values.get("srcset", "").strip().split(",")[0].split(" ")[0]:
                self.flush()
                digest = source[len(SCHEME) :].lower() if source.startswith(SCHEME) else None
                self.items.append({"position": len(self.items), "kind": "media", "text": source, "digest": digest, "caption": values.get("alt") or None})
        elif tag in html.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append((len(self.items), None))
            elif tag == "figcaption" and self.figures:
                self.end_caption()
                self.caption, self.captioned = [], len(self.figures) - 1

    def end(self, tag: str) -> None:
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in html.BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()


def items(page: str) -> list[dict]:
    found = _Items()
    for kind, what, inside in html.tokens(page):
        if kind == "start":
            found.start(what, inside)
        elif kind == "end":
            found.end(what)
        else:
            (found.words if found.caption is None else found.caption).append(what)
    found.flush()
    while found.figures:
        found.end_figure()
    found.hand_out()
    return found.items


def parse(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """The columns of keep and items, the page's sequence."""
    keep = [c for c in keep if c.lower() != "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "__html")):
            own = [items(h or "") for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.list_(_ITEM))], names=[*keep, "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return pages.select(*keep, F.col(column).cast("string").alias("__html")).mapInArrow(run, f"{kinds}, items array<{ITEM}>")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of WIDTH samples a row; the payload must fill its rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The payload of an image that to_png made."""
    at, data, width = 8, [], WIDTH
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IHDR":
            width = struct.unpack(">I", image[at + 8 : at + 12])[0]
        elif kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def filled(text: str) -> bytes:
    payload = text.encode("utf-8", "surrogatepass")
    return payload + FILL * ((-len(payload)) % UNIT if payload else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """(digest, media): the text of each document as an image, once for each digest (sha256 of the text's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole)):
            images = [to_png(filled(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(images, pa.binary())], names=["digest", "media"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # images are smaller than texts, so that they and not these are shuffled
    images = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")).mapInArrow(run, "digest string, media binary")
    return images.groupBy("digest").agg(F.first("media").alias("media"))


def feature(samples: np.ndarray) -> str:
    """Height, mean and an 8-bin histogram of the samples."""
    bins = np.bincount(samples >> 5, minlength=8)
    return f"{len(samples) // WIDTH}:{int(samples.sum())}:{'.'.join(map(str, bins))}"


def describe(media: DataFrame) -> DataFrame:
    """digest and what the stored bytes say when they are read back."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, 256) for whole in batches for low in range(0, whole.num_rows, 256)):
            rows = []
            for image in batch.column("media").to_pylist():
                payload = from_png(image)
                rows.append((len(payload.rstrip(FILL)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], names=["digest", *names])

    return media.mapInArrow(run, "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each item: the columns of keep, position, kind, text, digest, caption and the store's columns for its digest."""
    rows = sequences.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    return rows.join(media, "digest", "left")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Each document as a page that shows its text as a figure, parsed and resolved.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption.
    """
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed"))
    for sign, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(sign), F.lit(shown))
    page = F.concat(F.lit("<article><h1>Document</h1><figure><img src='" + SCHEME), digest, F.lit("'><figcaption>text of "), name, F.lit("</figcaption></figure></article>"))
    sequences = parse(docs.select("doc_id", page.alias("html")), ["doc_id"])
    found = resolve(sequences, describe(store(docs)), ["doc_id"]).filter("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
