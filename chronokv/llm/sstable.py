"""Token-ID output: sorted-string-table shards keyed by document.

A shard is one file: data blocks, a sparse index with each block's first key, a Bloom filter
over the documents' identifiers, and a footer that locates both. Within a block a key is stored
as the number of bytes it shares with the key before it and the rest; each block's first key is
whole. The manifest names every shard with its first and last key. A lookup takes the shards
whose range holds the identifier, reads footer, index and filter by ranges of the file, asks the
filter, finds the first block by binary search and reads that block (and the next ones while
they begin with the same identifier).

Layout, little-endian::

    block    zlib( record* )   record = shared u8, rest u8, n_ids u32, rest bytes, ids (n_ids x width)
    index    n x ( offset u64, length u32, first key 17 bytes )
    bloom    bits
    footer   index offset u64, blocks u32, bloom offset u64, bloom bytes u32, hashes u8,
             width u8, records u64, ids u64, b"SSTOKEN1"

Keys are 17 bytes that sort as (doc_id nulls first, ordinal): a flag, the doc_id with its sign
bit flipped and an ordinal that ascends within the output, both big-endian. So null and repeated
identifiers are kept, each as a record of its own; among repeated ones the order is by a hash of
the text.
"""

from __future__ import annotations

import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokv.llm.common import binary_view, checked_broadcast, gathered, scratch_dir, settled, stage, text_bytes, tidy
from chronokv.llm.tokens import encoder, vocabulary

MAGIC = b"SSTOKEN1"
FOOTER = struct.Struct("<QIQIBBQQ8s")
ENTRY = struct.Struct("<QI17s")
RECORD = struct.Struct("<BBI")
HASHES = 7
DOC = 9  # the bytes of a key that name the document
SHARD = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a URI: local, HDFS or an object store."""
    if not urlparse(uri).scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), urlparse(uri).path
    return pyarrow.fs.FileSystem.from_uri(uri)


def put(uri: str, blob: bytes) -> None:
    """Writes under another name, then renames: a task that runs twice leaves one whole file."""
    import uuid

    store, path = file_system(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own, compression=None) as f:
        f.write(blob)
    store.move(own, path)


def opened(uri: str) -> pa.NativeFile:
    """The file for reading by ranges."""
    store, path = file_system(uri)
    return store.open_input_file(path)


def spread(files: DataFrame) -> DataFrame:
    """A list of files (uri) dealt out evenly, so that many tasks read them."""
    n = files.count()
    return files.repartition(max(1, min(n, 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    return b"\0" * 9 + struct.pack(">Q", ordinal) if doc_id is None else b"\1" + struct.pack(">QQ", (doc_id + (1 << 63)) & ((1 << 64) - 1), ordinal)


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _bits(keys: list[bytes], m: int) -> np.ndarray:
    h = np.array([(zlib.crc32(k), zlib.adler32(k[::-1]) * 2654435761 + zlib.crc32(k[::-1])) for k in keys], dtype=np.uint64).reshape(-1, 2)
    return (h[:, :1] + np.arange(HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(m)


class Writer:
    """Takes records in key order; ``finish`` gives the shard's bytes."""

    def __init__(self, width: int = 2, block: int = 64 << 10):
        self.width, self.block, self.out, self.index, self.keys, self.total = width, block, bytearray(), [], [], 0
        self._open()

    def _open(self) -> None:
        self.held, self.size, self.first, self.last = [], 0, None, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.held += [RECORD.pack(shared, len(key) - shared, len(ids)), key[shared:], raw]
        self.size += len(raw) + 24
        self.last = key
        self.keys.append(key)
        self.total += len(ids)
        if self.size >= self.block:
            self._close()

    def _close(self) -> None:
        if self.held:
            blob = zlib.compress(b"".join(self.held), 1)
            self.index.append(ENTRY.pack(len(self.out), len(blob), self.first))
            self.out += blob
            self._open()

    def finish(self) -> bytes:
        self._close()
        at = len(self.out)
        m = max(64, (len(self.keys) * 10 + 7) // 8 * 8)
        bits = np.zeros(m, np.uint8)
        if self.keys:
            bits[_bits(sorted({k[:DOC] for k in self.keys}), m).ravel().astype(np.int64)] = 1
        bloom = np.packbits(bits).tobytes()
        index = b"".join(self.index)
        return bytes(self.out) + index + bloom + FOOTER.pack(at, len(self.index), at + len(index), len(bloom), HASHES, self.width, len(self.keys), self.total, MAGIC)


class Reader:
    """Reads a shard by ranges of its file; ``blocks_read`` counts the blocks that were read."""

    def __init__(self, file: pa.NativeFile):
        self.file, size, self.blocks_read = file, file.size(), 0
        self.at, self.blocks, self.bloom_at, self.bloom_n, _, self.width, self.records, self.total, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw = file.read_at(self.blocks * ENTRY.size, self.at)
        self.entries = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(self.blocks)]
        self.bloom = file.read_at(self.bloom_n, self.bloom_at)

    def block(self, i: int):
        offset, length, _ = self.entries[i]
        self.blocks_read += 1
        raw, p, key = zlib.decompress(self.file.read_at(length, offset)), 0, b""
        while p < len(raw):
            shared, rest, n = RECORD.unpack_from(raw, p)
            p += RECORD.size
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, np.frombuffer(raw, dtype=f"<u{self.width}", count=n, offset=p)
            p += n * self.width

    def __iter__(self):
        for i in range(self.blocks):
            yield from self.block(i)

    def may_hold(self, doc: bytes) -> bool:
        return all(self.bloom[int(b) >> 3] >> (7 - (int(b) & 7)) & 1 for b in _bits([doc], len(self.bloom) * 8)[0])

    def find(self, doc_id: int | None):
        """(key, ids) of every record of the document."""
        doc = key_of(doc_id)[:DOC]
        if not self.records or not self.may_hold(doc):
            return
        lo, hi = 0, self.blocks  # the last block that begins before the identifier, or the first
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.entries[mid][2][:DOC] < doc else (lo, mid)
        for i in range(lo, self.blocks):
            if self.entries[i][2][:DOC] > doc:
                return
            for key, ids in self.block(i):
                if key[:DOC] > doc:
                    return
                if key[:DOC] == doc:
                    yield key, ids


def write_shards(docs: DataFrame, uri: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 24 << 20, block: int = 64 << 10) -> DataFrame:
    """Encodes ``docs`` and writes shards below ``uri`` in ascending key order.

    Returns the manifest, one row per shard: (part, shard, uri, records, n_ids, first_key, last_key).
    A null text has no ids but the end id; null and repeated doc_ids are kept (see above); an
    empty table gives no shard; other columns are ignored. Documents are dealt by ranges of
    (doc_id, hash of the text), so that a doc_id with very many rows is split as well.
    """
    spark = docs.sparkSession
    path = tokenizer or vocabulary("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data")).withColumn("salt", F.xxhash64("data"))

    def write(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        shard, writer = 0, None
        ordinal, done = 0, []

        def close():
            nonlocal shard, writer
            # Each attempt writes names of its own, and the manifest has those of the attempt that Spark commits.
            blob, name = writer.finish(), f"{uri}/part-{part:06d}-{shard:06d}-{attempt}.sst"
            put(name, blob)
            done.append((part, shard, name, len(writer.keys), writer.total, writer.keys[0], writer.keys[-1]))
            shard, writer = shard + 1, None

        for batch in gathered(batches, "data"):
            e = encoder(path)
            width = 2 if e.tokenizer.get_vocab_size() <= 1 << 16 else 4
            ids, at = e.encode(*binary_view(batch.column("data")))
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                key = key_of(d, (part << 40) + ordinal)
                ordinal += 1
                if writer is None:
                    writer = Writer(width, block)
                writer.add(key, ids[at[i] : at[i + 1]])
                if len(writer.out) >= shard_bytes:
                    close()
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), SHARD, strict=True)], names=["part", "shard", "uri", "records", "n_ids", "first_key", "last_key"])

    ordered = rows.repartitionByRange(*_parts(spark), "doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return stage(ordered.select("doc_id", "data").mapInArrow(tidy(write, keeps=True), "part int, shard int, uri string, records long, n_ids long, first_key binary, last_key binary"), "manifest")


def _parts(spark: SparkSession) -> list[int]:
    return [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def read_shards(manifest: DataFrame) -> DataFrame:
    """The records of every shard in the manifest: (uri, doc_id, n_before, ids), ids as 32-bit little-endian.

    ``n_before`` counts the ids of the records before it in its shard. One block is held at a time.
    """

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                docs, starts, raws, at, size = [], [], [], 0, 0
                with opened(name) as file:
                    for key, ids in Reader(file):
                        raw = ids.astype("<u4").tobytes()
                        docs.append(doc_of(key)), starts.append(at), raws.append(raw)
                        at, size = at + len(ids), size + len(raw)
                        if size >= 4 << 20:
                            yield _records(name, docs, starts, raws)
                            docs, starts, raws, size = [], [], [], 0
                if docs:
                    yield _records(name, docs, starts, raws)

    return spread(manifest.select("uri")).mapInArrow(tidy(read), "uri string, doc_id long, n_before long, ids binary")


def _records(name, docs, starts, raws) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(raws, pa.binary())], names=["uri", "doc_id", "n_before", "ids"])


def lookup(manifest: DataFrame, ids: list[int | None]) -> DataFrame:
    """The records of the given documents: (uri, doc_id, n_before, ids); ``n_before`` is null, as nothing before it is read.

    ``ids`` is the caller's list; only shards whose range of keys holds one of them are opened,
    each by ranges. Unknown identifiers have no row, repeated ones a row for each record.
    """
    wanted = sorted({key_of(i)[:DOC] for i in ids})
    here = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<binary>")
    doc = lambda c: F.substring(c, 1, DOC)
    shards = manifest.where(F.exists(here, lambda w: (doc("first_key") <= w) & (w <= doc("last_key"))))

    def read(batches):
        for batch in batches:
            for name, first, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with opened(name) as file:
                    reader = Reader(file)
                    for w in wanted:
                        if first[:DOC] <= w <= last[:DOC]:
                            for key, ids in reader.find(doc_of(w)):
                                yield _records(name, [doc_of(key)], [None], [ids.astype("<u4").tobytes()])

    return spread(shards.select("uri", "first_key", "last_key")).mapInArrow(tidy(read), "uri string, doc_id long, n_before long, ids binary")


def bases(manifest: DataFrame) -> DataFrame:
    """(uri, base): the number of ids in the shards before each.

    The window without a key runs over one row per written range, of which there are as many as
    shuffle partitions; within a range the shards are numbered apart.
    """
    ranges = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return manifest.join(F.broadcast(ranges), "part").select("uri", (F.col("earlier") + inner).alias("base"))


@settled
def token_shards(docs: DataFrame, tokenizer: str | None = None, uri: str | None = None) -> DataFrame:
    """Writes the shards below ``uri``, reads them back and gives a row per document with its place.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, uri. Without
    ``uri`` the shards are written to the scratch folder and deleted after they were read.
    """
    manifest = write_shards(docs, uri or f"{scratch_dir(docs.sparkSession)}/tokens", tokenizer)
    records = read_shards(manifest).select("uri", "doc_id", "n_before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    base = checked_broadcast(stage(bases(manifest), "bases"))
    return records.join(base, "uri").select("doc_id", (F.col("base") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32", "uri")
