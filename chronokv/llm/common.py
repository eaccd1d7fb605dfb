"""Helpers that the corpus operators share: table access, staging, byte views."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What a batch of texts handed to Python holds at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 32 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can see.

    Where that is unset, a session on one machine (tests) gets a folder of its own; on a cluster
    it is an error, as a folder of one machine would lose files there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{_one_machine()}"
    return f"{root.rstrip('/')}/chronokv-{uuid.uuid4().hex}"


@functools.cache
def _one_machine() -> str:
    return tempfile.mkdtemp(prefix="chronokv-")


@dataclass
class Scratch:
    """A folder and the tables over it."""

    root: str
    tables: list[str]


#: The open scratch folders, the innermost last.
_OPEN: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is staged within goes to a folder of its own, deleted with its tables at the end.

    Arrow batches are bounded by ``BATCH`` meanwhile; the session's own settings come back at the
    end. Results that outlive the block are written by :func:`finished`.
    """
    here = Scratch(shared_dir(spark), [])
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, most in BATCH.items():
        spark.conf.set(k, str(min(most, int(before[k])) if before[k].isdigit() and int(before[k]) else most))
    _OPEN.append(here)
    try:
        yield here
    finally:
        _OPEN.remove(here)
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in here.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(here.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_path(spark: SparkSession, name: str) -> str:
    """Where a scratch table lies; it is dropped with the innermost scratch folder."""
    if not _OPEN:
        return f"{shared_dir(spark)}/{name}"
    _OPEN[-1].tables.append(name)
    return f"{_OPEN[-1].root}/{name}"


def scratch_dir(spark: SparkSession) -> str:
    """The innermost scratch folder, or a new shared one."""
    return _OPEN[-1].root if _OPEN else shared_dir(spark)


def _written(df: DataFrame, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the innermost scratch folder, or to a new shared one, and returns the written table.

    Cuts the lineage without a single copy on an executor: a lost executor costs nothing that
    was staged. What is not deterministic (partition numbers, say) is fixed by it.
    """
    return _written(df, scratch_dir(df.sparkSession), name)


def finished(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` beyond the innermost scratch folder and returns the written table."""
    return _written(df, _OPEN[-2].root if len(_OPEN) > 1 else shared_dir(df.sparkSession), name)


def settled(f):
    """Runs an operator at once in a scratch folder; only its result is left, as a written table."""

    @functools.wraps(f)
    def run(first: DataFrame, *args, **named) -> DataFrame:
        with scratch(first.sparkSession):
            return finished(f(first, *args, **named), f.__name__)

    return run


def fresh(name: str, *taken: str) -> str:
    """``name``, with underscores before it until no column has it."""
    lower = {t.lower() for t in taken}
    while name in lower:
        name = f"_{name}"
    return name


def checked_broadcast(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Broadcasts a staged table of ``rows`` narrow rows at most, counted; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_bytes(column: str = "text"):
    """The text as UTF-8, a null as no bytes."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def text_key(text: str) -> Column:
    """128 bits that stand for a text; a null is an empty one."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(body, F.lit(1)).alias("b"))


#: What a Python worker keeps from task to task; dropped when it runs something else.
KEPT: list[dict] = []


def tidy(f, keeps: bool = False):
    """``f`` over batches; afterwards the worker gives freed memory back, as it lives on for other stages."""

    def run(batches):
        from chronokv.llm import common  # the worker's own module, not a copy of its state

        if not keeps:
            for kept in common.KEPT:
                kept.clear()
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def binary_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls; the offsets start at 0."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32 if pa.types.is_binary(array.type) or pa.types.is_string(array.type) else np.int64)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if array.buffers()[2] is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Row ranges (lo, hi) of the batch whose ``column`` holds ``most`` bytes at most, or one row."""
    _, offsets = binary_view(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def gathered(batches, column: str, most: int = 8 << 20, rows: int = 100_000):
    """Joins successive record batches until ``column`` holds ``most`` bytes or there are ``rows`` rows; splits larger ones."""
    held, size = [], 0
    for batch in batches:
        for lo, hi in pieces(batch, column, most):
            part = batch.slice(lo, hi - lo)
            n = int(binary_view(part.column(column))[1][-1])
            if held and (size + n > most or sum(x.num_rows for x in held) + part.num_rows > rows):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def binary_array(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`binary_view`."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(parts))])


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words8(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), dtype="<u8", buffer=padded.data, strides=(1,))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses a row's end."""
    inside = ~IS_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = False, False
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] |= inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a step."""
    eight, length = words8(data), end - start
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, left = start.copy(), length.copy()
    live = np.arange(len(start))
    while len(live):
        n = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (n * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        h[live] = mix(h[live] ^ ((eight[at] & mask) * np.uint64(0x9E3779B97F4A7C15)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each ``width``-word shingle; a row of fewer words has one shingle of all of them."""
    start, end, row = word_spans(data, offsets)
    h = word_hashes(data, start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(row) >= width else np.zeros(0, np.int64)
    out = np.zeros(len(full), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x100000001B3) + h[full + k] + np.uint64(k + 1))
    few = np.flatnonzero((count > 0) & (count < width))
    at = np.searchsorted(row, few)
    tail = np.zeros(len(few), np.uint64)
    for k in range(width - 1):
        has = count[few] > k
        tail[has] = mix(tail[has] * np.uint64(0x100000001B3) + h[at[has] + k] + np.uint64(k + 1))
    tail = mix(tail + count[few].astype(np.uint64))
    hashes, rows = np.concatenate([out, tail]), np.concatenate([row[full], few])
    order = np.argsort(rows, kind="stable") if len(few) else slice(None)
    return hashes[order], rows[order]
