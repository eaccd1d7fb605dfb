"""Seekable Zstandard WARC bundles.

Each WARC record is compressed as a Zstandard frame of its own. A skippable frame with a seek
table ends the bundle: for each frame its compressed and plain size, as in the public seekable
format, so plain tools read the bundle as one stream and this module decodes one frame alone.
Bundles may group several records into a frame (``group``); the record map then gives, for each
record identifier, the frame, the record's offset within the plain frame and its length, so that
one record is read by three ranges of its bundle: footer, table and frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.chunks import NULL_ID, chunk_of, chunked, expand, others_of, rows_of
from chronokv.llm.chunks import opened as texts_of
from chronokv.llm.common import checked_broadcast, scratch_dir, settled, stage, tidy
from chronokv.llm.sstable import opened, put, spread

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
EPOCH = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, row: int) -> str:
    """The identifier of a row's record; rows that repeat a page_id, or have none, have their own."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}"


def record(kind: str, page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: tuple[int | None, int] | None) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and size but not the payload.

    ``refers_to``: page_id and row of the response that a revisit stands for.
    """
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    body = http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id, row)}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Identified-Payload-Length: {n_bytes}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(*refers_to)}>"]
        if refers_to[0] is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to[0]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(blob: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at an offset."""
    end = blob.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in blob[at:end].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    body = blob[end + 4 : end + 4 + n]
    return head, body[body.index(b"\r\n\r\n") + 4 :], end + 8 + n


class Bundle:
    """Writes frames, then the seek table."""

    def __init__(self, level: int = 3, group: int = 1 << 16):
        import zstandard

        self.frame = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.group, self.out, self.table, self.held, self.size, self.records = group, [], [], [], 0, 0
        self.bytes = 0

    def add(self, blob: bytes) -> tuple[int, int]:
        """(frame, offset in the plain frame) of the record; a frame holds ``group`` bytes or one record."""
        if self.held and self.size + len(blob) > self.group:
            self._close()
        place = len(self.table), self.size
        self.held.append(blob)
        self.size += len(blob)
        self.records += 1
        return place

    def _close(self) -> None:
        if self.held:
            packed = self.frame(b"".join(self.held))
            self.out.append(packed)
            self.bytes += len(packed)
            self.table.append((len(packed), self.size))
            self.held, self.size = [], 0

    def finish(self) -> bytes:
        self._close()
        n = len(self.table)
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", n, 0, SEEKABLE)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, out, at = file.read_at(8 * n, end - 9 - 8 * n), [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def frame(file: pa.NativeFile, i: int, table: list[tuple[int, int, int]] | None = None) -> bytes:
    """One frame's plain bytes; the others are not read."""
    import zstandard

    at, packed, plain = (table or seek_table(file))[i]
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """(row, first: page_id and row) of every row that repeats a payload of ``least`` bytes or more.

    ``pages``: (row, page_id, digest, n_bytes). The response is the row with the smallest page_id,
    nulls last, and of these the smallest row. Payloads that occur once never reach the join; of
    those that repeat one row per digest is sent to all tasks while they are few.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = pages.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    return pages.join(checked_broadcast(stage(first, "first")), ["digest", "n_bytes"]).where("first.row <> row").select("row", F.col("first.page_id").alias("page"), F.col("first.row").alias("of"))


def write_bundles(pages: DataFrame, uri: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", bundle_bytes: int = 32 << 20, group: int = 1 << 16) -> DataFrame:
    """Writes a record for every page; returns the record map.

    Columns: page_id, record_id, record_type, uri, frame, frame_offset, length. Of pages with
    equal payloads of ``least`` bytes or more the one with the smallest page_id (null last, then
    the first row in the order of the input's files) is a response and the others are revisits of
    it; smaller payloads are all responses. A null html is an empty payload. An empty table writes
    nothing; other columns are ignored. Payloads stay in the chunks that they were packed into:
    only digests and decisions are shuffled.
    """
    named = pages if url in pages.columns else pages.withColumn(url, F.lit(None).cast("string"))
    chunks = chunked(named.withColumn(url, F.col(url).cast("string")), page_id, html, others=[url])

    def digests(batches):
        for x in rows_of(batches):
            data, at, ids = texts_of(x)
            raw = data.tobytes()
            some = [hashlib.sha1(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(expand(x["uids"], np.int64)), pa.array(ids, mask=ids == NULL_ID), pa.array(some, pa.binary()), pa.array(np.diff(at))], names=["row", "page_id", "digest", "n_bytes"])

    keys = stage(chunks.select("ids", "uids", "offsets", "body").mapInArrow(tidy(digests), "row long, page_id long, digest binary, n_bytes long"), "digests")
    chunk, place = chunk_of("row")
    # A chunk holds rows of bounded size, so its decisions are bounded too.
    told = decide(keys, least).groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct(place.alias("place"), "page", "of")).alias("revisits"))
    marked = chunks.join(told.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "uids", "offsets", "body", "others", "revisits")

    def write(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        bundle, shard, held = Bundle(group=group), 0, []

        def close():
            nonlocal bundle, shard, held
            # Each attempt writes names of its own, and the map has those of the attempt that Spark commits.
            name = f"{uri}/part-{part:06d}-{shard:06d}-{attempt}.warc.zst"
            put(name, bundle.finish())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(p, i, k, name, f, o, n) for p, i, k, (f, o), n in held], strict=True), kinds, strict=True)], names=["page_id", "record_id", "record_type", "uri", "frame", "frame_offset", "length"])
            bundle, shard, held = Bundle(group=group), shard + 1, []
            return out

        for x in rows_of(batches):
            data, at, ids = texts_of(x)
            raw, rows = data.tobytes(), expand(x["uids"], np.int64).tolist()
            links = others_of(x).column(0).to_pylist()
            again = {r["place"]: (r["page"], r["of"]) for r in x["revisits"] or []}
            for i, p in enumerate(None if d == NULL_ID else d for d in ids.tolist()):
                payload, first = raw[at[i] : at[i + 1]], again.get(i)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = "revisit" if first else "response"
                blob = record(kind, p, rows[i], links[i], b"" if first else payload, digest, len(payload), first)
                held.append((p, record_id(p, rows[i]), kind, bundle.add(blob), len(blob)))
                if bundle.bytes >= bundle_bytes:
                    yield close()
        if held:
            yield close()

    return stage(marked.mapInArrow(tidy(write), "page_id long, record_id string, record_type string, uri string, frame int, frame_offset long, length long"), "record-map")


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, ok boolean, record_id string, refers_to_record string"


def _row(head: dict[str, str], payload: bytes) -> tuple:
    digest, n, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Identified-Payload-Length"]), head["WARC-Type"]
    own = kind == "revisit" or (len(payload) == n and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    number = lambda x: int(x) if x else None
    plain = lambda x: x and x.strip("<>")
    return (number(head["WARC-Page-ID"]), head["WARC-Target-URI"], kind, payload if kind == "response" else None, n, digest, number(head.get("WARC-Refers-To-Page-ID")), own, plain(head["WARC-Record-ID"]), plain(head.get("WARC-Refers-To")))


def read_bundles(record_map: DataFrame) -> DataFrame:
    """Every record of the bundles in the record map, with the columns of ``RECORDS``; one frame is held at a time.

    ``payload`` is null for a revisit. ``ok``: a response's payload has the digest and size that its header states.
    """

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with opened(name) as file:
                    table = seek_table(file)
                    for i in range(len(table)):
                        plain, at = frame(file, i, table), 0
                        while at < len(plain):
                            head, payload, at = parse(plain, at)
                            rows.append(_row(head, payload))
                            size += len(payload) + 200
                        if size >= 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return spread(record_map.select("uri").distinct()).mapInArrow(tidy(read), RECORDS)


def lookup(record_map: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records that rows of ``wanted`` (record_id) name in the record map, with the columns of ``RECORDS``.

    Of a bundle only the seek table and the frames that hold such records are read. Unknown
    identifiers have no row.
    """
    places = record_map.join(wanted.select("record_id").distinct(), "record_id").select("uri", "frame", "frame_offset")

    def read(batches):
        name, file, table = None, None, None
        for batch in batches:
            for uri, i, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != name:
                    if file:
                        file.close()
                    name, file = uri, opened(uri)
                    table = seek_table(file)
                head, payload, _ = parse(frame(file, i, table), at)
                yield _rows([_row(head, payload)])
        if file:
            file.close()

    return places.sortWithinPartitions("uri", "frame").mapInArrow(tidy(read), RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "ok", "record_id", "refers_to_record"])


@settled
def archive(pages: DataFrame, least: int = 0, uri: str | None = None) -> DataFrame:
    """Writes the bundles below ``uri``, reads them back and gives a row per page: what its record says.

    ``refers_to`` is null for a response, and for a revisit of a response without a page_id.
    Without ``uri`` the bundles go to the scratch folder and are deleted after they were read.
    """
    read = read_bundles(write_bundles(pages, uri or f"{scratch_dir(pages.sparkSession)}/warc", least))
    checked = F.when(F.col("ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("string"))
    return read.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


#: Base32 of a SHA-1: 32 groups of five bits, taken from the hexadecimal digits' numbers.
ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, html, hex, min(page_id) OVER (PARTITION BY html) AS first,
    list_transform(range(8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INT, 5))::BIGINT) AS five
  FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((five[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
