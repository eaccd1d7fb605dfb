"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs; a figure's caption
stays with its reference. References name their media by digest, and a join on the digest
resolves them against a media store. A digest that very many references name is resolved by a
small table sent to all tasks, so that it is no hot key. Stored media are 8-bit greyscale PNG images, 64 samples
wide; the number of bytes before padding is a text chunk of the image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import binary_view, checked_broadcast, fresh, gathered, settled, stage, text_bytes, tidy

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256:"


def padded(text: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return text + b"\0" * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload's bytes as samples; ``n_bytes`` of them are the content."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(blob: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes); checks the signature, every chunk's checksum and the size."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, n, data = 8, None, 0, []
    while at < len(blob):
        length, kind = struct.unpack(">I", blob[at : at + 4])[0], blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + length]
        if struct.unpack(">I", blob[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if size[2:4] != (8, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit greyscale is stored")
    return lines[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Height, mean, deviation, entropy and mean difference of neighbours."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    some = share[share > 0]
    level = np.arange(256)
    mean = float(share @ level)
    steps = np.abs(np.diff(samples.astype(np.int16)))
    return f"{len(samples) // WIDTH}x{WIDTH} mean={mean:.4f} std={float(share @ (level - mean) ** 2) ** 0.5:.4f} entropy={abs(float(-(some * np.log2(some)).sum())):.4f} step={float(steps.mean()):.4f}"


class _Sequence(HTMLParser):
    BLOCKS = frozenset("p div article section figure figcaption h1 h2 h3 h4 h5 h6 li ul ol table tr td th br blockquote pre nav header footer body title".split())
    SKIPPED = frozenset(("script", "style"))
    MEDIA = frozenset(("img", "video", "audio", "source"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.held, self.skip, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text:
            if self.caption is not None:
                self.caption.append(text)
            else:
                self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        if tag in self.BLOCKS or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA and (src := dict(attrs).get("src")):
            item = {"kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            words, self.caption = " ".join(self.caption), None
            if self.figure:
                for item in self.figure:
                    item["caption"] = words
            elif words:
                self.items.append({"kind": "text", "text": words, "ref": None, "caption": None})
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def parse(html: str) -> list[dict]:
    """The ordered items of one page; broken markup is read as far as it goes."""
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser.flush()
    return parser.items


ITEMS = "row long, doc_id long, position int, kind string, text string, digest string, caption string"
HOT = 1000  # references to one digest from which it is resolved apart


def items(pages: DataFrame, doc_id: str = "doc_id", html: str = "html", row: str | None = None) -> DataFrame:
    """One row per item: (row, doc_id, position, kind, text, digest, caption), positions from 0 in reading order.

    ``digest`` is the reference without its ``media:sha256:`` prefix; other references stay as
    they are. A null or empty page has no items; repeated and null doc_ids are kept, and ``row``
    (the column of this name, or a number given here) tells their pages apart. Other columns are
    ignored.
    """

    def run(batches):
        for batch in gathered(batches, "html"):
            out = []
            for r, d, h in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "html")), strict=True):
                for k, x in enumerate(parse(h.decode("utf-8", "replace"))):
                    ref = x["ref"] and x["ref"].removeprefix(SCHEME)
                    out.append((r, d, k, x["kind"], x["text"], ref, x["caption"]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "position", "kind", "text", "digest", "caption"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    return pages.select(number.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(html).alias("html")).mapInArrow(tidy(run), ITEMS)


def resolve(sequence: DataFrame, store: DataFrame, hot: int = HOT) -> DataFrame:
    """Joins references with what ``store`` (a row per digest, with any columns) has of them.

    The items keep their positions and captions; one whose digest the store lacks, or that has
    none, keeps nulls. Columns of the store that clash are prefixed with ``media_``, and with an
    underscore more while that is taken too. ``sequence`` is read more than once, so it should be
    a written table. Items without a reference and digests of ``hot`` references or more take no
    part in the shuffle.
    """
    taken = [*sequence.columns, *store.columns]
    clash = {c: fresh(f"media_{c}", *taken) for c in store.columns if c != "digest" and c in sequence.columns}
    known = store.withColumnsRenamed(clash).dropDuplicates(["digest"])
    often = stage(sequence.where("digest is not null").groupBy("digest").count().where(F.col("count") >= hot).select("digest"), "often")
    named = sequence.where("digest is not null")
    cold = named.join(checked_broadcast(often), "digest", "left_anti").join(known, "digest", "left")
    there = checked_broadcast(stage(often.join(known, "digest", "left"), "hot"))
    return cold.unionByName(named.join(there, "digest")).unionByName(sequence.where("digest is null"), allowMissingColumns=True)


def describe(store: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: a row per distinct digest.

    Columns: digest (of the stored form), n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.
    """

    def run(batches):
        for batch in batches:
            out = []
            for blob in batch.column(0):
                blob = blob.as_py()
                payload, n = from_png(blob)
                digest = hashlib.sha256(blob).hexdigest()
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(blob), digest, feature(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    said = store.select("media").mapInArrow(tidy(run), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return said.groupBy("digest").agg(*[F.min(c).alias(c) for c in said.columns if c != "digest"])


PAGE = "row long, doc_id long, html string, digest string, media binary"


def _stored(batches):
    """Batches of (row, doc_id, data): an image of each text and a page of the text and that image."""
    for batch in gathered(batches, "data"):
        data, at = binary_view(batch.column("data"))
        raw, html, digest, media = data.tobytes(), [], [], []
        for i, d in enumerate(batch.column("doc_id").to_pylist()):
            body = raw[at[i] : at[i + 1]]
            blob = to_png(padded(body), len(body))
            digest.append(hashlib.sha256(blob).hexdigest())
            media.append(blob)
            first, *rest = escape(body.decode("utf-8", "replace")).split("\n")
            figure = f'<figure><img src="{SCHEME}{digest[-1]}"><figcaption>document {"null" if d is None else d}</figcaption></figure>'
            html.append(f"<article><p>{first}</p>{figure}{''.join(f'<p>{x}</p>' for x in rest)}</article>")
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["row", "doc_id", "html", "digest", "media"])


def _told(batches):
    """Of each page what its sequence says of the image: (row, doc_id, media, position, digest, caption, n_items, text_chars)."""
    for batch in batches:
        out = []
        for html in batch.column("html").to_pylist():
            sequence = parse(html)
            at, item = next((k, x) for k, x in enumerate(sequence) if x["kind"] == "media")
            out.append((at, item["ref"].removeprefix(SCHEME), item["caption"], len(sequence), sum(len(x["text"]) for x in sequence if x["text"])))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("media"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["row", "doc_id", "media", "position", "digest", "caption", "n_items", "text_chars"])


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as an image and writes a page of the text and that image: (row, doc_id, html, digest, media).

    The page has the whole text, a paragraph for each line, with the figure after the first. A
    null text is an empty one; its image has one line of zeros.
    """
    return stage(_numbered(docs, doc_id, text).mapInArrow(tidy(_stored), PAGE), "media")


@settled
def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with what its stored payload says, see :func:`describe`, and of its sequence.

    ``position`` and ``caption`` are those of the media item; ``n_items`` counts the sequence's
    items and ``text_chars`` the characters of its text items. Whole texts are stored, and their
    pages parsed as they are made, so that no text is written twice; only references and
    descriptions are shuffled. An empty table gives no rows; null and repeated doc_ids are kept.
    """
    store = stage(_numbered(docs, doc_id, text).mapInArrow(tidy(lambda batches: _told(_stored(batches))), "row long, doc_id long, media binary, position int, digest string, caption string, n_items long, text_chars long"), "media")
    return resolve(store.drop("media", "row"), stage(describe(store), "described")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "text_chars")


@settled
def page_sequences(pages: DataFrame, store: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """The items of raw pages, their references resolved against ``store``: see :func:`items` and :func:`resolve`."""
    return resolve(stage(items(pages, doc_id, html), "items"), store)
