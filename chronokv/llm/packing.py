"""Packing by minimum bin slack.

Every document is cut into whole windows of ``capacity`` tokens and one remainder. Only the
histogram of the remainders' lengths (at most ``capacity`` numbers, whatever the corpus) goes
to the driver. There each step fills one window: a bitset subset-sum dynamic programme over the
multiset of lengths finds the reachable sum closest to the capacity, backtracking gives how
many of each length it takes, and the pattern is repeated as often as the counts allow. So the
plan has a few thousand patterns at any size, and Spark deals the pieces out to the patterns'
slots by their rank among the pieces of equal length.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronokv.llm.common import binary_view, checked_broadcast, gathered, settled, stage, text_bytes, tidy
from chronokv.llm.tokens import encoder, vocabulary


def fullest(counts: dict[int, int], capacity: int, must: int | None = None) -> dict[int, int]:
    """The sub-multiset of ``counts`` whose sum is closest to ``capacity`` from below.

    ``must``: a length that is taken once in any case (default: the largest). Bit s of a set is
    1 where the sum s can be reached; a length with many copies enters as 1, 2, 4, ... copies,
    and the sets after each of these are kept for the way back.
    """
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    must = lengths[0] if must is None else must
    room, mask = capacity - must, (1 << (capacity - must + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left, k = min(counts[x] - (x == must), room // x), 1
        while left > 0:
            k = min(k, left)
            steps.append((x, k, reach))
            reach |= reach << (x * k) & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {must: 1}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= x * k
            taken[x] = taken.get(x, 0) + k
    assert at == 0
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a window, number of such windows), until no length is left."""
    left = {x: n for x, n in histogram.items() if n}
    out = []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[x] // k for x, k in pattern.items())
        out.append((pattern, times))
        for x, k in pattern.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the ranks from which a pattern takes it, with its count, first window and offset."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for pattern, times in patterns:
        at = 0
        for x in sorted(pattern, reverse=True):
            k = pattern[x]
            out.setdefault(x, []).append((used.get(x, 0), k, first, at))
            used[x] = used.get(x, 0) + k * times
            at += x * k
        first += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def tokenized_pieces(docs: DataFrame, capacity: int, tokenizer: str | None, doc_id: str, text: str) -> DataFrame:
    """Pieces with ids: (part, doc_id, doc_tokens, start, length, nth, ids, ids_crc32).

    ``nth`` counts the pieces of equal length within the part, which is fixed by the staging.
    """
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))

    def cut(batches):
        import zlib

        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches, "data", 3 << 20):
            ids, at = encoder(path).encode(*binary_view(batch.column("data")))
            n = np.diff(at)
            k = (n + capacity - 1) // capacity
            row = np.repeat(np.arange(len(n)), k)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * capacity
            length = np.minimum(capacity, n[row] - start)
            nth = np.empty(len(row), np.int64)
            order = np.argsort(length, kind="stable")
            of = length[order]
            run = np.flatnonzero(np.diff(of, prepend=-1))
            nth[order] = np.arange(len(of)) - np.repeat(run, np.diff(np.append(run, len(of)))) + seen[of]
            seen += np.bincount(length, minlength=capacity + 1)
            small = ids.astype("<u2") if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else ids
            place = at[row] + start
            raw = [small[p : p + m].tobytes() for p, m in zip(place.tolist(), length.tolist(), strict=True)]
            crc = np.array([zlib.crc32(ids[p : p + m].astype("<u4").tobytes()) for p, m in zip(place.tolist(), length.tolist(), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part, np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(n[row]), pa.array(start), pa.array(length), pa.array(nth), pa.array(raw, pa.binary()), pa.array(crc)], names=["part", "doc_id", "doc_tokens", "start", "length", "nth", "ids", "ids_crc32"])

    return stage(rows.mapInArrow(tidy(cut, keeps=True), "part int, doc_id long, doc_tokens long, start long, length long, nth long, ids binary, ids_crc32 long"), "pieces")


@settled
def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs documents into sequences of ``capacity`` tokens at most.

    One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and ids
    (binary, 16-bit for vocabularies up to 65,536 ids). A null or empty text is a document of
    one token, the end id. Null and repeated doc_ids are documents of their own. An empty table
    gives no rows. Other columns are ignored.
    """
    all_pieces = tokenized_pieces(docs, capacity, tokenizer, doc_id, text)
    counts = stage(all_pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(histogram, capacity))
    # A row for each part and length: a piece's rank among all of its length.
    before = counts.select("part", F.col("length"), (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = all_pieces.join(checked_broadcast(stage(before, "before"), 500_000), ["part", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        edges = np.flatnonzero(np.diff(n[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = order[lo:hi]
            x = int(n[at[0]])
            begin, each, first, place = table[x]
            k = np.searchsorted(begin, r[at], "right") - 1
            inner = r[at] - begin[k]
            sequence[at] = first[k] + inner // each[k]
            offset[at] = place[k] + inner % each[k] * x
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = place("length", (F.col("before") + F.col("nth")))
    return ranked.withColumn("at", at).select("doc_id", "start", "length", "doc_tokens", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"), "ids_crc32", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids in order: (sequence_id, n_tokens, ids). A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def padding(histogram: dict[int, int], capacity: int) -> int:
    """Tokens of padding in the plan for a histogram."""
    return sum((capacity - sum(x * k for x, k in p.items())) * t for p, t in plan(histogram, capacity))

