"""Interleaved document sequences of text and media.

HTML is parsed into an ordered list of parts: text, or a reference to a payload by digest with its caption.
Payloads lie in a store of media files, one row for each, named by the SHA-256 of the payload; references are
resolved by an equi-join on the digest, and parts keep their positions, so text, media and captions stay
aligned. What is wanted of a payload (lengths, checks, features) is computed on the store's side, so that no
payload is shuffled; copies of a payload meet as one row for each digest before the join.

Media are grey images in PNG: 8-bit samples, WIDTH to a row, no filter, so any bytes whose number is a positive
multiple of WIDTH are kept without loss. Reading checks every chunk's CRC.

Defined cases: nothing inside script, style or template is a part, neither text nor media; a caption that is not
closed ends with its figure, or where a section, table, heading or another figure begins; null text is an empty
payload (one row of padding); a reference whose digest the store lacks
keeps its place with null columns; html that is null or has no part gives no part; repeated rows each get a
row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textblock as tb
from terravane.runtime import arrow_limits, cut, discard, ship

WIDTH = 576
SCHEME = "sha256:"
SIGNATURE = b"\x89PNG\r\n\x1a\n"

_BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "article", "section", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "title", "nav", "header", "footer", "body", "html"}
_SILENT = {"script", "style", "template"}
#: Tags that end a caption whose own end is missing.
_ENDS_CAPTION = {"figure", "article", "section", "body", "html", "table", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Parts(HTMLParser):
    """Parts in reading order: ("text", text, None, None) or ("media", None, reference, caption)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def close_text(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text.clear()
        if t:
            self.parts.append(["text", t, None, None])

    def close_caption(self) -> None:
        if self.caption is None:
            return
        words = " ".join("".join(self.caption).split())
        self.caption = None
        start = self.figures[-1] if self.figures else 0
        media = [p for p in self.parts[start:] if p[0] == "media"]
        if media:  # the figure's media share its caption
            for p in media if self.figures else media[-1:]:
                p[3] = words or p[3]
        elif words:
            self.parts.append(["text", words, None, None])

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag in ("img", "video", "audio", "source") and at.get("src"):
            self.close_text()
            self.parts.append(["media", None, at["src"], at.get("alt") or None])
        elif tag == "figcaption":
            self.close_caption()
            self.close_text()
            self.caption = []
        elif tag in _BREAKS:
            if tag in _ENDS_CAPTION:
                self.close_caption()
            self.close_text()
            if tag == "figure":
                self.figures.append(len(self.parts))

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "figcaption":
            self.close_caption()
        elif tag in _BREAKS:
            if tag in _ENDS_CAPTION:
                self.close_caption()
            self.close_text()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    p = _Parts()
    p.feed(html or "")
    p.close()
    p.close_caption()
    p.close_text()
    return [{"position": i, "kind": k, "text": t, "reference": r, "caption": c} for i, (k, t, r, c) in enumerate(p.parts)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload, a positive multiple of width bytes, as the samples of a grey image."""
    rows = len(payload) // width
    lines = np.zeros((rows, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of an 8-bit grey image without filters."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, width, rows = 8, [], 0, 0
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            width, rows = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()


def padded(text: bytes, width: int = WIDTH) -> bytes:
    """text with bytes 255 up to a positive multiple of width."""
    return text + b"\xff" * ((-len(text)) % width or (0 if text else width))


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and share of padding of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    v = np.arange(256)
    mean = float((p * v).sum())
    sd = float((p * (v - mean) ** 2).sum()) ** 0.5
    q = p[p > 0]
    return f"mean={mean:.4f};sd={sd:.4f};entropy={float(-(q * np.log2(q)).sum()):.4f};pad={p[255]:.4f};rows={len(payload) // WIDTH}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tb.blocks(batches):
        payloads = [padded(t) for t in texts]
        digests = [hashlib.sha256(p).hexdigest() for p in payloads]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_png(p) for p in payloads], pa.binary())], names=["doc_id", "digest", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = []
        for named, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
            m = media.as_py()
            p = from_png(m)
            d = hashlib.sha256(p).hexdigest()
            if d != named:
                raise ValueError(f"payload {named} reads back as {d}")
            rows.append([named, len(p), d, zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=_READ)


_READ = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_PARTS = "array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(h) for h in batch.column(1).to_pylist()], kind)], names=["id", "parts"])


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(id, parts): each page's ordered parts."""
    ship(pages.sparkSession)
    arrow_limits(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("id"), F.col(html).cast("string").alias("html")).mapInArrow(_sequences, f"id {kind}, parts {_PARTS}")


def features(store: DataFrame) -> DataFrame:
    """One row for each digest of store (digest, media): its payload read back, checked and described."""
    read = store.select("digest", "media").mapInArrow(_read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*(F.first(c).alias(c) for c in _READ[1:]))


def resolved(parts: DataFrame, read: DataFrame) -> DataFrame:
    """parts (id, parts) exploded to (id, position, kind, text, reference, caption), with the columns of read (what
    features made of a store) for media."""
    each = parts.select("id", F.inline("parts")).withColumn("digest", F.when(F.col("reference").startswith(SCHEME), F.substring("reference", len(SCHEME) + 1, 64)))
    return each.join(read, "digest", "left")


def rejoined(each: DataFrame) -> DataFrame:
    """(id, parts): what resolved made, as ordered sequences again."""
    part = F.struct("position", "kind", "text", "reference", "caption", "payload_sha256", "feature")
    return each.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("parts"))


def stored_documents(docs: DataFrame) -> DataFrame:
    """Every document as a page whose figure holds its payload: stored, parsed, resolved and read back."""
    spark = docs.sparkSession
    ship(spark)
    arrow_limits(spark)
    store = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored, "doc_id long, digest string, n_bytes long, media binary"), "media")
    figure = F.concat(F.lit(f'<article><figure><img src="{SCHEME}'), "digest", F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    parts = sequences(store.select("doc_id", figure.alias("html")), "doc_id", "html")
    read = cut(features(store), "features")
    each = resolved(parts, read).filter("kind = 'media'")
    result = cut(each.select(F.col("id").alias("doc_id"), F.split_part("caption", F.lit(" "), F.lit(1)).cast("long").alias("n_bytes"), *_READ[1:], "position", "caption"), "media-result")
    discard(store, read)
    return result


def page_sequences(pages: DataFrame) -> DataFrame:
    """(page_id, position, kind, text, reference, caption): the parts of every page's html, in order."""
    return sequences(pages).select(F.col("id").alias("page_id"), F.inline("parts"))
