"""Suffix-array deduplication by a run-length index.

Every string of ``length`` bytes is dealt to a group by the smallest hash among its inner
``kgram``-byte strings, so equal strings meet in one group, and neighbours with the same
smallest hash travel as one piece. Hashes of one document only are dropped beforehand, exactly:
what they cover cannot repeat.

In a group the text of the pieces that a larger document may repeat is indexed: its suffix array
gives the Burrows-Wheeler transform and is dropped; what stays are the runs, the suffix samples
at their ends, the text, and the smallest document of each interval of equal strings, run by run.
The pieces of the other documents stream their matching statistics over the runs, from right to
left; where a match of ``length`` bytes or more is found, the interval that it lies in names the
smallest document that has the string. Pieces of the smallest document of all that share a hash
are settled without that. Strings of larger documents are marked, and the marks of a document
are united into the bytes to remove.

A passage of very many documents does not gather its occurrences in one task: its pieces are
reduced to the distinct ones, with their smallest and largest document, over groups of chunks;
only these go on to the index, and each group of chunks gets one answer.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronokv.llm.chunks import CHUNK_BYTES, NULL_ID, bits_for, chunked, classes_of, count_classes, distinct_pairs, expand, opened, others_of, portion, rows_of, squeeze
from chronokv.llm.common import binary_view, fresh, mix, settled, stage, text_bytes, tidy, words8

LENGTH = 50
KGRAM = 26
PIECE = 128  # starts in a piece at most
HOT = 11  # class of a hash in 1024 documents or more: its strings are dealt by a second hash too, and reduced over groups of chunks
MOST_CHUNK, LEAST_BUCKET, MOST_BUCKET = 16 << 20, 2 << 20, 16 << 20  # bytes of text
SENT = 2 << 20  # bytes of messages that leave a worker at once
LOT = 8 << 20  # bytes that are indexed and searched at once, but for those of one hash


def _sliding(h: np.ndarray, width: int, f=np.minimum) -> np.ndarray:
    """The least (or, by np.maximum, largest) of each ``width`` successive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


BLOCK = 1 << 15  # starts at a step, so that a step's arrays stay in the processor's cache


def kgram_hashes(data: np.ndarray, kgram: int = KGRAM) -> np.ndarray:
    """A 64-bit hash of every ``kgram`` successive bytes, ``kgram`` eight at least."""
    w, last = words8(data), len(data) - kgram + 1
    h = np.zeros(last, np.uint64)
    for k, at in enumerate([*range(0, kgram - 8, 8), kgram - 8]):
        part = w[at : at + last]
        h += part * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1) + (part >> np.uint64(29)) * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3)) & (2**64 - 1) | 1)
    return mix(h)


def minima(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, least hash) of the runs of string starts in one row with one least hash."""
    none = np.zeros(0, np.int64)
    total = len(data) - length + 1
    if total <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    size = np.diff(offsets)
    has = size >= length
    first, stop = offsets[:-1][has], offsets[1:][has] - length + 1  # where a row's starts begin and end
    heads, values, before = [], [], None
    for lo in range(0, total, BLOCK):
        hi = min(total, lo + BLOCK)
        least = _sliding(kgram_hashes(data[lo : hi + length - 1], kgram), length - kgram + 1)
        head = np.empty(hi - lo, dtype=bool)
        head[0] = before is None or least[0] != before
        head[1:] = least[1:] != least[:-1]
        head[first[np.searchsorted(first, lo) : np.searchsorted(first, hi)] - lo] = True
        at = np.flatnonzero(head)
        heads.append(at + lo)
        values.append(least[at])
        before = least[-1]
    start, value = np.concatenate(heads), np.concatenate(values)
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], total)
    bound = np.zeros(len(size), np.int64)
    bound[has] = stop
    end = np.minimum(end, bound[row])
    ok = start < end
    return start[ok], end[ok], row[ok], value[ok]


def _keys(length: int, kgram: int):
    def keys_of(data, offsets):
        _, _, row, least = minima(data, offsets, length, kgram)
        return distinct_pairs(row, mix(least))  # least hashes alone would crowd the first buckets

    return keys_of


class RunIndex:
    """The run-compressed transform of a text, its samples, and a number for every row, also by runs.

    ``numbers(suffix array)`` gives the rows' numbers; the suffix array itself is not kept.
    """

    def __init__(self, text: np.ndarray, numbers=None):
        self.text, self.n, self.eight = text, len(text), words8(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        head = np.ones(self.n, dtype=bool)
        head[1:] = bwt[1:] != bwt[:-1]
        start = np.flatnonzero(head)
        end = np.append(start[1:], self.n)
        char = bwt[start].astype(np.int64)
        self.runs, self.row_start, self.origin = len(start), start, int(sa[0])
        by = np.argsort(char, kind="stable")
        self.char, self.start, self.end = char[by], start[by], end[by]
        size = self.end - self.start
        self.lf = np.cumsum(size) - size  # where a run's first row goes: runs of smaller bytes, then earlier ones
        self.key = self.char * (self.n + 1) + self.start
        self.place = np.empty(len(by), np.int64)  # from the runs in the rows' order to those by bytes
        self.place[by] = np.arange(len(by))
        self.first, self.last = sa[self.start], sa[self.end - 1]  # samples at the runs' ends
        if numbers is not None:
            each = numbers(sa)
            self.steps = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            self.values = each[self.steps]

    def run_at(self, row: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.row_start, row, "right") - 1]

    def number(self, row: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.steps, row, "right") - 1]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes the suffixes at a and b share, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(0, most, 8):
            pa_, pb = a[live] + k, b[live] + k
            ok = (pa_ < self.n) & (pb < self.n)
            live, pa_, pb = live[ok], pa_[ok], pb[ok]
            x = self.eight[pa_] ^ self.eight[pb]
            same = x == 0
            low = x[~same]
            low &= ~low + np.uint64(1)
            out[live[~same]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            live = live[same]
            out[live] = k + 8
        return np.minimum(np.minimum(out, most), self.n - np.maximum(a, b))

    def stream(self, start: np.ndarray, end: np.ndarray, text: np.ndarray, most: int = 64):
        """Matching statistics of the patterns text[start:end], all patterns in step, from the right.

        Yields (patterns, place, row, statistic): for these patterns the row of the index whose
        suffix shares ``statistic`` bytes with the pattern from ``place`` on; ``most`` at most.
        """
        order = np.argsort(start - end, kind="stable")
        size = (end - start)[order]
        row = np.zeros(len(order), np.int64)
        at = np.full(len(order), self.origin, np.int64)
        stat = np.zeros(len(order), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -step, "left"))  # patterns with a byte here
            place = end[order[:m]] - 1 - step
            c = text[place].astype(np.int64)
            q, p, s = row[:m], at[:m], stat[:m]
            run = self.run_at(q)
            off = np.flatnonzero(self.char[run] != c)  # the row's byte is another: go to the nearest run of this one
            if len(off):
                up = np.searchsorted(self.key, c[off] * (self.n + 1) + q[off], "right") - 1
                down = up + 1
                can_up = (up >= 0) & (self.char[np.maximum(up, 0)] == c[off])
                can_down = (down < self.runs) & (self.char[np.minimum(down, self.runs - 1)] == c[off])
                far_up, far_down = np.full(len(off), -1, np.int64), np.full(len(off), -1, np.int64)
                far_up[can_up] = self.common(p[off][can_up], self.last[up[can_up]], most)
                far_down[can_down] = self.common(p[off][can_down], self.first[down[can_down]], most)
                take_up = can_up & (far_up >= far_down)
                dead = ~can_up & ~can_down
                chosen = np.where(take_up, up, np.minimum(down, self.runs - 1))
                run[off] = chosen
                q = q.copy()
                q[off] = np.where(take_up, self.end[chosen] - 1, self.start[chosen])
                p = p.copy()
                p[off] = np.where(take_up, self.last[chosen], self.first[chosen])
                s = s.copy()
                s[off] = np.minimum(s[off], np.maximum(far_up, far_down))
            row[:m] = self.lf[run] + (q - self.start[run])
            at[:m] = p - 1
            stat[:m] = np.minimum(s + 1, most)
            if len(off) and dead.any():
                gone = off[dead]
                row[gone], at[gone], stat[gone] = 0, self.origin, 0
            at[:m] %= self.n
            yield order[:m], place, row[:m], stat[:m]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling from eight bytes; only suffixes that still tie are sorted again.

    A suffix that ends first is the smaller one. The text must not end in a zero byte, which
    stands for what lies beyond the end.
    """
    n, eight = len(text), words8(text)
    order = np.argsort(eight.byteswap())
    w = eight[order]
    head = np.ones(n, dtype=bool)
    head[1:] = w[1:] != w[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while len(tied := np.flatnonzero(~(head & np.append(head[1:], True)))):
        at = order[tied]
        after = at + depth
        first, second = rank[at], np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.argsort(first * (n + 1) + second + 1)
        order[tied], first, second = at[by], first[by], second[by]
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head[tied] = fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        depth *= 2
    return order


def spliced(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[begin : begin + size] one after another, and their offsets."""
    at = np.concatenate([[0], np.cumsum(size)])
    out, lo = np.empty(at[-1], np.uint8), 0
    while lo < len(size):  # by steps, as places take eight times their bytes
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        out[at[lo] : at[hi]] = data[np.repeat(begin[lo:hi] - at[lo:hi], size[lo:hi]) + np.arange(at[lo], at[hi])]
        lo = hi
    return out, at


def smallest_owner(strings: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """For distinct strings with their smallest and largest documents: the smallest of every ``length``-byte string in them.

    Returns (owners, offsets): of string i the starts 0 .. size - length. Each string is a piece,
    so its first ``length`` bytes have the smallest hash of all; only pieces of one hash share
    strings. What the smallest document of a hash has needs no search; what only the largest has
    need not be found, and so nothing of a hash without other pieces (an exact copy's).
    """
    size = np.diff(offsets)
    starts = np.maximum(0, size - length + 1)
    out_at = np.concatenate([[0], np.cumsum(starts)])
    out = np.repeat(low, starts)
    if not len(size):
        return out, out_at
    wide, hashes = length - kgram + 1, np.zeros(len(size), np.uint64)
    step = max(1, BLOCK // length)
    for lo in range(0, len(size), step):
        begin = offsets[lo : min(len(size), lo + step)]
        heads = strings[np.minimum(begin[:, None] + np.arange(length), len(strings) - 1).ravel()]
        hashes[lo : lo + len(begin)] = kgram_hashes(np.append(heads, np.zeros(kgram, np.uint8)), kgram)[: len(heads)].reshape(-1, length)[:, :wide].min(axis=1)
    _, group = np.unique(hashes, return_inverse=True)
    first, last = np.full(group.max() + 1, NULL_ID), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(first, group, low)
    np.maximum.at(last, group, high)
    sought = low > first[group]
    busy = np.zeros(len(first), dtype=bool)
    busy[group[sought]] = True
    indexed = (low < last[group]) & busy[group]
    wanted = np.zeros(len(first), dtype=bool)
    wanted[group[indexed]] = True
    sought &= wanted[group]
    weight = np.bincount(group, np.where(indexed, size, 0) + np.where(sought, size, 0))
    lot = (np.cumsum(weight) // LOT).astype(np.int64)[group]  # hashes share no strings
    some = np.flatnonzero(indexed | sought)
    some = some[np.argsort(lot[some], kind="stable")]
    for part in np.split(some, np.flatnonzero(np.diff(lot[some])) + 1) if len(some) else []:
        _search(strings, offsets, low, part[indexed[part]], part[sought[part]], length, out, out_at)
    return out, out_at


def _search(strings: np.ndarray, offsets: np.ndarray, low: np.ndarray, indexed: np.ndarray, sought: np.ndarray, length: int, out: np.ndarray, out_at: np.ndarray) -> None:
    """Lowers ``out`` of the ``sought`` strings to the smallest documents that an index of the ``indexed`` ones names."""
    size = np.diff(offsets)
    plain, at = spliced(strings, offsets[:-1][indexed], size[indexed])
    patterns, pattern_at = spliced(strings, offsets[:-1][sought], size[sought])
    free = np.flatnonzero((np.bincount(plain, minlength=256) + np.bincount(patterns, minlength=256))[1:] == 0)
    if not len(free):
        raise ValueError("the strings use every byte; UTF-8 does not")
    n = len(indexed)
    text = np.full(len(plain) + n, free[-1] + 1, np.uint8)  # a byte that no string has ends each
    text[np.arange(len(plain)) + np.repeat(np.arange(n), np.diff(at))] = plain
    end = at[1:] + np.arange(n)

    def least_of(sa: np.ndarray) -> np.ndarray:
        of = np.searchsorted(end, sa)
        fits = sa + length <= end[of]
        same = np.zeros(len(sa), dtype=bool)
        live, eight = np.flatnonzero(fits[1:] & fits[:-1]) + 1, words8(text)
        for k in [*range(0, length - 8, 8), length - 8]:
            live = live[eight[sa[live] + k] == eight[sa[live - 1] + k]]
        same[live] = True
        interval = np.flatnonzero(~same)  # rows at which an interval of one string begins
        return np.repeat(np.minimum.reduceat(np.where(fits, low[indexed][of], NULL_ID), interval), np.diff(np.append(interval, len(sa))))

    index = RunIndex(text, least_of)
    base, wanted = out_at[:-1][sought], size[sought]
    for which, place, row, stat in index.stream(pattern_at[:-1], pattern_at[1:], patterns, -(-length // 8) * 8 + 8):
        begin = place - pattern_at[which]
        ok = (begin + length <= wanted[which]) & (stat >= length)
        if ok.any():
            to = base[which[ok]] + begin[ok]
            out[to] = np.minimum(out[to], index.number(row[ok]))


def _rows(table: pa.Table) -> list[dict]:
    return [{n: c[i].as_py() for n, c in zip(table.column_names, table.columns, strict=True)} for i in range(table.num_rows)]


def _distinct(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes, offsets) of the distinct strings of the parts (sizes, body), and for each part which they are."""
    sizes = [expand(p["sizes"], np.uint16).astype(np.int64) for p in parts]
    base = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate([expand(p["body"]) for p in parts]))]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    raw = coded.dictionary
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    text = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]]
    return text, off - off[0], [code[base[i] : base[i + 1]] for i in range(len(parts))]


def _span(kinds: int, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest document of each string."""
    least, most = np.full(kinds, NULL_ID, np.int64), np.full(kinds, np.iinfo(np.int64).min, np.int64)
    np.minimum.at(least, which, low)
    np.maximum.at(most, which, high)
    return least, most


def _marks(which: np.ndarray, doc: np.ndarray, least: np.ndarray, least_at: np.ndarray) -> bytes:
    """A bit for each start of the pieces: whether a smaller document has the string."""
    n = least_at[which + 1] - least_at[which]
    ends = np.cumsum(n)
    own = least[np.repeat(least_at[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return squeeze(np.packbits(own < np.repeat(doc, n)))


#: kind 0: a chunk's marks. Of a hot bucket, over a group of chunks: kind 1, the distinct strings
#: and their documents (sizes, body, low, high); kind 2, a chunk's pieces by these strings.
FOUND = "kind int, bucket int, part int, chunk long, at binary, starts binary, marks binary, sizes binary, body binary, low binary, high binary, string binary, ids binary"
FOUND_SCHEMA = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in FOUND.split(", ")])


def _meet(table: pa.Table, length: int, kgram: int) -> pa.Table:
    """For a bucket's pieces their marks; for those of a hot bucket what :func:`_settle` and :func:`_answer` need."""
    parts = _rows(table)
    text, offsets, codes = _distinct(parts)
    which = [code[expand(p["string"], np.uint32).astype(np.int64)] for p, code in zip(parts, codes, strict=True)]
    doc = [expand(p["ids"], np.int64) for p in parts]
    low, high = _span(len(offsets) - 1, np.concatenate(which), np.concatenate(doc), np.concatenate(doc))
    common = {"bucket": parts[0]["bucket"], "part": parts[0]["part"]}
    if common["part"] >= 0:
        out = [{"kind": 1, "sizes": squeeze(np.diff(offsets).astype(np.uint16)), "body": squeeze(text, 3), "low": squeeze(low), "high": squeeze(high)} | common]
        out += [{"kind": 2, "chunk": p["chunk"], "at": p["at"], "starts": p["starts"], "string": squeeze(w.astype(np.uint32)), "ids": p["ids"]} | common for p, w in zip(parts, which, strict=True)]
    else:
        least, least_at = smallest_owner(text, offsets, low, high, length, kgram)
        out = [{"kind": 0, "chunk": p["chunk"], "at": p["at"], "starts": p["starts"], "marks": _marks(w, d, least, least_at)} | common for p, w, d in zip(parts, which, doc, strict=True)]
    return pa.Table.from_pylist(out, FOUND_SCHEMA)


def _settle(table: pa.Table, length: int, kgram: int) -> pa.Table:
    """The smallest documents of a hot bucket's strings, told to each group of chunks."""
    parts = _rows(table)
    text, offsets, codes = _distinct(parts)
    low, high = _span(len(offsets) - 1, np.concatenate(codes), np.concatenate([expand(p["low"], np.int64) for p in parts]), np.concatenate([expand(p["high"], np.int64) for p in parts]))
    least, least_at = smallest_owner(text, offsets, low, high, length, kgram)
    told = []
    for code in codes:
        n = least_at[code + 1] - least_at[code]
        ends = np.cumsum(n)
        told.append((squeeze(n), squeeze(least[np.repeat(least_at[code] - (ends - n), n) + np.arange(ends[-1])])))
    return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "n": pa.array([t[0] for t in told], pa.binary()), "least": pa.array([t[1] for t in told], pa.binary())})


def _answer(pieces: pa.Table, told: pa.Table) -> pa.Table:
    """The marks of a group of chunks, by the answer it was told."""
    reply = _rows(told)[0]
    n, least = expand(reply["n"], np.int64), expand(reply["least"], np.int64)
    least_at = np.concatenate([[0], np.cumsum(n)])
    marks = [_marks(expand(p["string"], np.uint32).astype(np.int64), expand(p["ids"], np.int64), least, least_at) for p in _rows(pieces)]
    return pa.table({"chunk": pieces.column("chunk"), "at": pieces.column("at"), "starts": pieces.column("starts"), "marks": pa.array(marks, pa.binary())})


def _parted(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end, largest hash) of the parts, with one largest hash each, of runs of string starts."""
    n = end - start
    runs, starts, ends, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    sent, lo = np.concatenate([[0], np.cumsum(n + length - 1)]), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(sent, sent[lo] + BLOCK, "right")) - 1)
        text, at = spliced(data, start[lo:hi], n[lo:hi] + length - 1)
        most = _sliding(kgram_hashes(text, kgram), length - kgram + 1, np.maximum)
        of = np.repeat(np.arange(hi - lo), n[lo:hi])
        within = np.arange(len(of)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        value, place = most[at[of] + within], start[lo:hi][of] + within
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]))
        runs.append(lo + of[first])
        starts.append(place[first])
        ends.append(place[np.append(first[1:], len(place)) - 1] + 1)
        values.append(value[first])
        lo = hi
    return np.concatenate(runs), np.concatenate(starts), np.concatenate(ends), np.concatenate(values)


def mark_repeats(chunks: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot_class: int = HOT) -> DataFrame:
    """(chunk, parts): for each chunk the places in its bytes whose string also starts in a smaller document."""
    total, n_chunks = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    bits = bits_for(total, portion(total, LEAST_BUCKET, MOST_BUCKET))
    shared = count_classes(chunks, _keys(length, kgram), bits)
    groups = max(1, math.isqrt(n_chunks))  # of chunks, for hot buckets
    hot_bits = max(1, bits_for(total) - 5)  # few pieces are hot: fewer, fuller buckets

    def send(batches):
        for x in rows_of(batches):
            data, offsets, ids = opened(x)
            start, end, row, least = minima(data, offsets, length, kgram)
            deal = mix(least)
            keys, which = np.unique(deal, return_inverse=True)
            kind = classes_of(keys, x["parts"], bits)[which]
            own = int(mix(np.array([x["chunk"]], np.uint64))[0] % np.uint64(groups))
            cool, hot = np.flatnonzero((kind > 0) & (kind < hot_class)), np.flatnonzero(kind >= hot_class)
            run, first, stop, most = _parted(data, start[hot], end[hot], length, kgram)
            of = np.concatenate([cool, hot[run]])
            if not len(of):
                continue
            start, end, row = np.concatenate([start[cool], first]), np.concatenate([end[cool], stop]), row[of]
            deal, part = np.concatenate([deal[cool], mix(deal[hot[run]] ^ most)]), np.where(np.arange(len(of)) < len(cool), -1, own).astype(np.int32)
            n = (end - start + PIECE - 1) // PIECE
            of = np.repeat(np.arange(len(start)), n)
            begin = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
            size = np.minimum(end[of] - begin, PIECE) + length - 1
            bucket = (deal[of] >> np.where(part[of] < 0, 64 - bits, 64 - hot_bits).astype(np.uint64)).astype(np.int32)
            order = np.lexsort((begin, part[of], bucket))
            begin, size, bucket, part, doc = begin[order], size[order], bucket[order], part[of[order]], ids[row[of[order]]]
            edges = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]), [True]]))
            held, n_bytes = [], 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                text, at = spliced(data, begin[lo:hi], size[lo:hi])
                coded = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(text)]).dictionary_encode()
                kinds, kinds_at = binary_view(coded.dictionary)
                held.append((bucket[lo], part[lo], x["chunk"], squeeze(np.diff(kinds_at).astype(np.uint16)), squeeze(kinds, 3), squeeze(coded.indices.to_numpy().astype(np.uint32)), squeeze(np.diff(begin[lo:hi], prepend=0)), squeeze((size[lo:hi] - length + 1).astype(np.uint16)), squeeze(doc[lo:hi])))
                n_bytes += sum(map(len, held[-1][3:]))
                if n_bytes > SENT or hi == edges[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=["bucket", "part", "chunk", "sizes", "body", "string", "at", "starts", "ids"])
                    held, n_bytes = [], 0

    joined = chunks.join(shared.hint("shuffle_hash"), "chunk").select("chunk", "ids", "offsets", "body", "parts")
    sent = joined.mapInArrow(tidy(send), "bucket int, part int, chunk long, sizes binary, body binary, string binary, at binary, starts binary, ids binary")
    found = stage(sent.groupBy("bucket", "part").applyInArrow(lambda t: _meet(t, length, kgram), FOUND), "found")
    marked = found.where("kind = 0").select("chunk", "at", "starts", "marks")
    if found.where("kind = 1").limit(1).count():
        told = found.where("kind = 1").select("bucket", "part", "sizes", "body", "low", "high").groupBy("bucket").applyInArrow(lambda t: _settle(t, length, kgram), "bucket int, part int, n binary, least binary")
        pieces = found.where("kind = 2").select("bucket", "part", "chunk", "at", "starts", "string", "ids")
        answered = pieces.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(_answer, "chunk long, at binary, starts binary, marks binary")
        marked = marked.union(answered)
    return marked.groupBy("chunk").agg(F.collect_list(F.struct("at", "starts", "marks")).alias("parts"))


def covered(n: int, parts: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """The bytes of a chunk that a marked string covers."""
    marked = np.zeros(n + length - 1, dtype=bool)
    for p in parts or []:
        begin, starts = np.cumsum(expand(p["at"], np.int64)), expand(p["starts"], np.uint16).astype(np.int64)
        ends = np.cumsum(starts)
        marks = np.unpackbits(expand(p["marks"]))[: int(ends[-1]) if len(ends) else 0].astype(bool)
        marked[(np.repeat(begin - (ends - starts), starts) + np.arange(len(marks)))[marks] + length - 1] = True
    return _sliding(marked, length, np.logical_or)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the bytes are set in each document."""
    total = np.cumsum(mask, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    return np.diff(np.where(offsets > 0, total[offsets - 1], 0).astype(np.int64)) if len(mask) else np.zeros(len(offsets) - 1, np.int64)


def _left(x: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(ids, sizes, removed bytes, removed spans, and what is left of each document, in order) of a chunk with its marks."""
    data, offsets, ids = opened(x)
    gone = covered(len(data), x["parts"], length)
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    head[first] |= gone[first]
    removed, left = _sums(gone, offsets), data[~gone]
    kept_at = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
    return ids, np.diff(offsets), removed, _sums(head, offsets), [left[kept_at[i] : kept_at[i + 1]].tobytes() for i in range(len(ids))]


def _with_marks(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    return chunks.join(marks.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "offsets", "body", "others", "parts")


def _chunk_bytes(docs: DataFrame, text: str) -> int:
    return portion(docs.agg(F.sum(F.octet_length(text_bytes(text)))).first()[0] or 0, CHUNK_BYTES, MOST_CHUNK)


@settled
def remove_repeats(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, doc_id: str = "doc_id", text: str = "text", hot_class: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), kept_sha256.

    A byte goes if a ``length``-byte string that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input. A null text is an empty one. A null doc_id
    counts as larger than all others; rows with equal doc_ids do not remove from each other. An
    empty table gives no rows; other columns are ignored.
    """
    chunks = chunked(docs, doc_id, text, _chunk_bytes(docs, text))

    def keep(batches):
        for x in rows_of(batches):
            ids, sizes, removed, spans, kept = _left(x, length)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _with_marks(chunks, mark_repeats(chunks, length, kgram, hot_class)).mapInArrow(tidy(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, the repeated passages cut out of the text.

    Where a cut parts a character, its other bytes go too. A text that was null stays null. The
    chunks and marks that the result reads stay until the caller's ``scratch`` block ends.
    """
    names = [c for c in docs.columns if c != text]
    absent = fresh("absent", *names)
    chunks = chunked(docs.withColumn(absent, F.col(text).isNull()), doc_id, text, _chunk_bytes(docs, text), others=[*names, absent])
    marks = mark_repeats(chunks, length, kgram)
    out = StructType([*[StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(names)], StructField("left", StringType())])

    def keep(batches):
        for x in rows_of(batches):
            *columns, missing = others_of(x).columns
            texts = [None if gone else t.decode("utf-8", "ignore") for t, gone in zip(_left(x, length)[-1], missing.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=out.names)

    rows = _with_marks(chunks, marks).mapInArrow(tidy(keep), out)
    return rows.select(*[F.col("left" if c == text else f"c{names.index(c)}").alias(c) for c in docs.columns])
