"""Chunks of whole texts, and counts of 64-bit keys over all documents.

Documents are packed into compressed chunks, staged once in a bucketed table, so that what is
learned of a chunk later is joined to it without moving texts again. A key's document count is
found by an exchange of packed arrays: a chunk sends each bucket of the hash space the distinct
keys it holds, sorted, and gets back a byte for each, the count's class: 0 for one document,
then 1 + floor(log2(count)) for more, so 2 is two or three.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import binary_view, gathered, table_path, text_bytes, tidy

NULL_ID = np.int64(2**63 - 1)
CHUNK_BYTES = 4 << 20
KEY_BYTES = 5


@functools.cache
def _compressor(level: int):
    """Kept by the worker: to make one takes longer than to compress a small array."""
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def expand(blob: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(blob), dtype=dtype)


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, others: list[str] | None = None) -> DataFrame:
    """(chunk, ids, uids, offsets, body, n_bytes, others): ids, uids and offsets are arrays of 64-bit numbers.

    A null doc_id is the largest number; uids number the rows. ``others`` names columns that stay
    with the documents: as the Arrow stream of their batch, so that every type comes back as it was.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), text_bytes(text).alias("data"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others or [])])

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(gathered(batches, "data", chunk_bytes)):
            data, at = binary_view(batch.column("data"))
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            uids = uid_of(part << 32 | k, np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([squeeze(uids.astype(np.int64))], pa.binary()), pa.array([squeeze(at)], pa.binary()), pa.array([squeeze(data, 3)], pa.binary()), pa.array([len(data)], pa.int64()), pa.array([_stream(batch, len(others)) if others else None], pa.binary())], names=["chunk", "ids", "uids", "offsets", "body", "n_bytes", "others"])

    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(tidy(pack), "chunk long, ids binary, uids binary, offsets binary, body binary, n_bytes long, others binary")
    packed.write.option("path", table_path(spark, name)).option("compression", "uncompressed").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def _stream(batch: pa.RecordBatch, n: int) -> bytes:
    part = batch.select([f"c{k}" for k in range(n)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_batch(part)
    return squeeze(sink.getvalue().to_pybytes())


def others_of(row: dict) -> pa.RecordBatch:
    """The other columns of a chunk's documents."""
    return pa.ipc.open_stream(expand(row["others"]).tobytes()).read_next_batch()


def uid_of(chunk: int, place):
    """The number of a chunk's row: of the partition, the chunk within it (22 bits) and the row within that (20 bits)."""
    return (chunk >> 32 << 42) + ((chunk & 0xFFFFFFFF) << 20) + place


def chunk_of(uid: str):
    """The chunk of a uid that :func:`uid_of` gave, and its place there."""
    u = F.col(uid)
    return F.shiftleft(F.shiftright(u, 42), 32).bitwiseOR(F.shiftright(u, 20).bitwiseAND(F.lit((1 << 22) - 1).cast("long"))), u.bitwiseAND(F.lit((1 << 20) - 1).cast("long")).cast("int")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids) of a chunk."""
    return expand(row["body"]), expand(row["offsets"], np.int64), np.frombuffer(row["ids"], np.int64)


def rows_of(batches):
    """The rows as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def distinct_pairs(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, key) pairs, sorted by row, then key."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[fresh], key[fresh]


def key_counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs)."""
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that hold some of the sorted keys, where each begins, with the end)."""
    bucket = keys >> np.uint64(64 - bits)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return bucket[at].astype(np.int64), np.append(at, len(keys))


def portion(total: int, least: int, most: int) -> int:
    """A 64th of ``total`` bytes, from ``least`` to ``most``.

    Every chunk writes to every bucket, so that their messages grow with the square of the input;
    large chunks and buckets keep these few beside the bytes that they carry.
    """
    return min(most, max(least, -(-total // 64)))


def bits_for(total: int, bytes_each: int = 2 << 20) -> int:
    """So many buckets (as a power of two) that one has the keys of about ``bytes_each`` of ``total`` bytes of text, 2 at least."""
    return int(max(1, np.ceil(np.log2(max(2, total / bytes_each)))))


def bucket_bits(chunks: DataFrame, bytes_each: int = 2 << 20) -> int:
    return bits_for(chunks.agg(F.sum("n_bytes")).first()[0] or 0, bytes_each)


KeysOf = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def count_classes(chunks: DataFrame, keys_of: KeysOf, bits: int) -> DataFrame:
    """For each chunk the classes of its distinct keys: (chunk, parts: array of (bucket, classes)).

    ``keys_of(bytes, offsets)`` gives (row, key) pairs, distinct within a row. Keys are compared
    by ``bits`` + 40 of their bits; two that agree in these count as one, which can only raise a class.
    """

    def send(batches):
        for x in rows_of(batches):
            data, at, _ = opened(x)
            keys, n = key_counts(keys_of(data, at)[1])
            some, edges = by_bucket(keys, bits)
            low = (keys << np.uint64(bits) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            counts = n.astype(np.uint32)
            for lo in range(0, len(some), 256):
                part = range(lo, min(len(some), lo + 256))
                yield pa.RecordBatch.from_arrays([pa.array(some[part].astype(np.int32)), pa.array([x["chunk"]] * len(part), pa.int64()), pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in part], pa.binary()), pa.array([squeeze(counts[edges[b] : edges[b + 1]]) for b in part], pa.binary())], names=["bucket", "chunk", "keys", "counts"])

    def tally(table: pa.Table) -> pa.Table:
        chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        sizes, keys, counts = [], [], []
        for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
            raw = np.frombuffer(k.as_py(), np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :KEY_BYTES] = raw
            keys.append(wide.view("<u8").ravel())
            counts.append(expand(c.as_py(), np.uint32))
            sizes.append(len(raw))
        key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        total = np.add.reduceat(count[order], np.flatnonzero(head))
        kind = np.where(total > 1, 1 + np.floor(np.log2(total)), 0).astype(np.uint8)
        out = np.empty(len(key), np.uint8)
        out[order] = kind[np.cumsum(head) - 1]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([bucket] * len(chunk), pa.int32()), "classes": pa.array([squeeze(out[at[i] : at[i + 1]]) for i in range(len(chunk))], pa.binary())})

    sent = chunks.select("chunk", "ids", "offsets", "body").mapInArrow(tidy(send), "bucket int, chunk long, keys binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(tally, "chunk long, bucket int, classes binary")
    # A chunk is of bounded size, so its replies are too.
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "classes")).alias("parts"))


def classes_of(keys: np.ndarray, parts: list[dict] | None, bits: int) -> np.ndarray:
    """The reply to a chunk, in the order of its sorted distinct keys."""
    out = np.zeros(len(keys), np.uint8)
    begin = np.searchsorted(keys, np.array([p["bucket"] << (64 - bits) for p in parts or []], np.uint64))
    for p, lo in zip(parts or [], begin, strict=True):
        got = expand(p["classes"])
        out[lo : lo + len(got)] = got
    return out

