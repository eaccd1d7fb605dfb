"""Dense statistics of whole texts, for the classifiers; one vectorised pass over the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from chronokv.llm.common import LOWER, binary_view, gathered, text_bytes, tidy, word_hashes, word_spans

NAMES = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "mark", "symbol", "pipe", "exclaim", "foreign",
    "shout_words", "repeat_next", "distinct_words", "top_word", "lines", "repeat_lines", "short_lines", "function_words",
    "obfuscated", "letter_runs", "second_person", "lexicon", "lexicon_best", "lexicon_kinds", "lexicon_near_you", "lexicon_strong",
]
#: Pronouns of the second person in the corpus's languages.
SECOND = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros tus ti".split())
FUNCTION = frozenset("the and of to a in is that it for as with be by on this are was at from der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als le de la et les des en un du une que est pour qui dans a par plus pas au sur ne el y los se del las con no su una por para es al lo como más o pero sus".split())
STEMS = range(5, 9)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
MARK, SYMBOL = _class(".,;:!?'\"()-"), _class("%$&*#@^~_+=<>\\/[]{}`")
LETTER = UPPER | _class("abcdefghijklmnopqrstuvwxyz")
LETTER[0x80:] = True


def terms(word: str) -> list[str]:
    """What the lexicon may know a lower-case word by: itself and its stems of 5 to 8 letters."""
    return [f"={word}", *(word[:k] for k in STEMS if k < len(word))]


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(code, distinct words, row, start) of the runs of letters, A-Z lower-cased."""
    inside = LETTER[data]
    if not inside.any():
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] |= inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] |= inside[last]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[:-1:2], edges[1:-1:2], edges[-1] = start, stop, stop[-1]
    edges[2 * len(start) - 1 :] = stop[-1]
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(start) - 1, [None, pa.py_buffer(edges[: 2 * len(start)].copy()), pa.py_buffer(LOWER[data])])
    coded = pieces.take(pa.array(np.arange(0, 2 * len(start) - 1, 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(offsets, start, "right") - 1, start


class Lexicon:
    """Weights of terms; remembers what it said of words, within a bound."""

    def __init__(self, weights: dict[str, float], keep: int = 200_000):
        self.weights, self.keep, self.said = weights, keep, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.said) > self.keep:
            self.said = {}
        said, weights, out = self.said, self.weights, np.zeros(len(words))
        if not weights:
            return out
        for i, w in enumerate(words):
            x = said.get(w)
            if x is None:
                x = said[w] = max((weights.get(t, 0.0) for t in terms(w.decode("utf-8", "replace").lower())), default=0.0)
            if x:
                out[i] = x
        return out


def statistics(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = {}
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    upper, letters = UPPER[data], LETTER[data]
    n_letters = count(letters)
    for name, table in (("digit", DIGIT), ("mark", MARK), ("symbol", SYMBOL), ("pipe", _class("|")), ("exclaim", _class("!"))):
        out[name] = share(count(table[data]), size)
    out["upper"] = share(count(upper), n_letters)
    out["foreign"] = share(count(data >= 0x80), size)
    start, end, row = word_spans(data, offsets)
    words = np.bincount(row, minlength=n).astype(float)
    per = lambda flags, rows=row: np.bincount(rows, weights=flags, minlength=n)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    ups, lets = sums(upper), sums(letters)
    out["shout_words"] = share(per(((ups[end] - ups[start]) >= 2) & ((ups[end] - ups[start]) * 2 > (lets[end] - lets[start]))), words)
    out["word_length"] = share(per((end - start).astype(float)), words)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(words)
    h = word_hashes(LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["repeat_next"] = share(per(same), words)
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][fresh], minlength=n).astype(float)
    out["distinct_words"] = share(kinds, words)
    most = np.zeros(n)
    at = np.flatnonzero(fresh)
    np.maximum.at(most, row[order][at], np.diff(np.append(at, len(h))).astype(float))
    out["top_word"] = share(most, words)
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(np.append(breaks + 1, 0), offsets) if len(data) else np.zeros(1, np.int64)
    edges = edges[edges <= len(data)]
    lines = np.stack([edges[:-1], edges[1:]])
    lines = lines[:, lines[1] > lines[0]]
    line_row = np.searchsorted(offsets, lines[0], "right") - 1
    n_lines = np.bincount(line_row, minlength=n).astype(float)
    lh = word_hashes(data, lines[0], lines[1]) if lines.size else np.zeros(0, np.uint64)
    order = np.lexsort((lh, line_row))
    again = np.zeros(len(lh))
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out["repeat_lines"] = share(np.bincount(line_row[order], weights=again, minlength=n), n_lines)
    out["short_lines"] = share(np.bincount(line_row, weights=(lines[1] - lines[0]) < 30, minlength=n), n_lines)
    out["lines"] = np.log1p(n_lines)
    inner = np.zeros(len(data), dtype=bool)
    odd = (DIGIT | SYMBOL)[data]
    inner[1:-1] = odd[1:-1] & letters[:-2] & letters[2:] if len(data) > 2 else False
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    inner[offsets[1:][offsets[1:] > 0] - 1] = False
    out["obfuscated"] = share(count(inner), words)
    run = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        run[2:] = letters[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        for k in range(2):  # a run lies in one text
            early = offsets[:-1] + k
            run[early[early < len(data)]] = False
    out["letter_runs"] = share(count(run), words)
    code, kinds_, word_row, _ = letter_words(data, offsets)
    w = lexicon(kinds_)[code] if kinds_ else np.zeros(0)
    second = np.array([k in SECOND for k in kinds_], dtype=bool)[code] if kinds_ else np.zeros(0, bool)
    small = np.array([k.decode("utf-8", "replace") in FUNCTION for k in kinds_], dtype=bool)[code] if kinds_ else np.zeros(0, bool)
    n_words = np.bincount(word_row, minlength=n).astype(float)
    sum_of = lambda x: np.bincount(word_row, weights=x, minlength=n)
    hit = w > 0
    out["second_person"], out["function_words"] = share(sum_of(second), n_words), share(sum_of(small), n_words)
    out["lexicon"] = share(sum_of(w), n_words)
    best = np.zeros(n)
    np.maximum.at(best, word_row[hit], w[hit])
    out["lexicon_best"] = best
    out["lexicon_strong"] = share(sum_of(w * (w >= 0.75 * (max(lexicon.weights.values(), default=1.0)))), n_words)
    pair = np.unique(np.stack([word_row[hit], code[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
    out["lexicon_kinds"] = np.log1p(np.bincount(pair[:, 0], minlength=n).astype(float))
    near, you = np.zeros(len(w), dtype=bool), np.flatnonzero(second)
    for k in range(-5, 6):
        p = you + k
        ok = (p >= 0) & (p < len(w))
        ok[ok] &= word_row[p[ok]] == word_row[you[ok]]
        near[p[ok]] = True
    out["lexicon_near_you"] = share(sum_of(near & hit), n_words)
    return np.stack([out[k] for k in NAMES], axis=1) if n else np.zeros((0, len(NAMES)))


def with_statistics(docs: DataFrame, weights: dict[str, float] | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``stats`` (array of NAMES) of every row; the text itself is dropped."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, text_bytes(text).alias("_data"))
    schema = StructType([*rows.schema.fields[:-1], StructField("stats", ArrayType(DoubleType()))])

    def run(batches):
        lexicon = Lexicon(weights or {})
        for batch in gathered(batches, "_data", 4 << 20):
            got = statistics(*binary_view(batch.column("_data")), lexicon)
            flat = pa.array(got.ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, len(NAMES), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats], names=[*keep, "stats"])

    return rows.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the identifier's text mod 5 is 0; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most about ``most`` labelled training rows of each class: (text, label, weight, fold).

    The classes are thinned by a hash of the identifier, and ``weight`` undoes that. ``fold`` is
    0 to 9 by another hash. Rows of the held-out fifth are never among them. Labels of a doc_id
    that has several are averaged and rounded; null labels and identifiers are left out.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("label")).where(~held_out("doc_id"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    fraction = {k: min(1.0, most / max(1, n)) for k, n in total.items()}
    kept = F.lit(0.0)
    for k, f in fraction.items():
        kept = F.when(F.col("label") == k, F.lit(f)).otherwise(kept)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    rows = known.withColumn("kept", kept).where(uniform < F.col("kept")).select("doc_id", "label", F.try_divide(F.lit(1.0), F.col("kept")).alias("weight"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).cast("int").alias("fold"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(rows) if sum(min(n, most) for n in total.values()) <= 100_000 else rows, "doc_id")
