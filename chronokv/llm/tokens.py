"""Token ids of whole texts, by the tokenizers library, one lookup for each distinct word.

A text is cut where the pre-tokenizers of both vocabularies cut in any case: before a single
space between visible characters, and between a letter and a following mark. The pieces then
have the same ids alone as within the text, so each distinct piece is encoded once and kept.
The file's added tokens (``<|endoftext|>``) are pieces of their own, as the library takes them
out of a text first, before it folds the case of the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa

from chronokv.llm.common import KEPT, LOWER

END_ID = 1


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: (pre-tokenizer, normalizer) of the files that the cuts hold for.
CUTTABLE = [
    (_BYTES | {"use_regex": True}, None),
    (
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]},
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    ),
]


_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)  # of two-byte characters from U+00C0, none of them a space
_LEAD[0xC3:0xE0] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in '.,;:!?$%&*#|()"<>=/+-_']] = True


def whole(data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of the ``added`` strings in the rows; of those that overlap the leftmost, the longest of them."""
    raw = data.tobytes()
    if not any(x in raw for x in added):
        return []
    pattern = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)))
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out += [m.span() for m in pattern.finditer(raw, lo, hi)]
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, kept: list[tuple[int, int]] = ()) -> np.ndarray:
    """The pieces' offsets, all of the rows' offsets among them; each span of ``kept`` is one piece."""
    n = len(data)
    if n < 3:
        return np.unique(np.concatenate([[0], offsets, [n]]))
    cut = np.zeros(n + 1, dtype=bool)
    before = _VISIBLE[data]
    before[1:] |= _LEAD[data[:-1]] & (data[1:] >= 0x80)
    after = _VISIBLE[data] | _LEAD[data]
    cut[1 : n - 1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    cut[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    for lo, hi in kept:
        cut[lo + 1 : hi] = False
        cut[lo] = cut[hi] = True
    cut[offsets] = True
    cut[0] = cut[n] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts, in pieces where that is safe; keeps the ids of at most ``2 * keep`` pieces."""

    def __init__(self, path: str, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.cuttable = (spec["pre_tokenizer"], spec["normalizer"]) in CUTTABLE
        self.folds = self.cuttable and spec["normalizer"] is not None
        self.keep, self.young, self.old = keep, {}, {}

    def ids(self, values: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit numbers."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(v) for v in values]
        missing = [i for i, x in enumerate(out) if x is None]
        fresh = []
        for i in missing:
            if (x := old.get(values[i])) is None:
                fresh.append(i)
            else:
                out[i] = young[values[i]] = x
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([values[i].decode("utf-8", "replace") for i in part], add_special_tokens=False), strict=True):
                out[i] = x = np.array(e.ids, dtype="<u4").tobytes()
                if len(values[i]) <= 64:
                    young[values[i]] = x
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each row's offset in them); every row ends with END_ID."""
        spans = whole(data, offsets, self.added)
        if self.folds:
            data = LOWER[data]
        at = cuts(data, offsets, spans) if self.cuttable else np.unique(np.concatenate([[0], offsets]))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        kinds = self.ids(coded.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in kinds], dtype=np.int64)
        flat = np.frombuffer(b"".join(kinds), dtype="<u4")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        code = coded.indices.to_numpy().astype(np.int64)
        n = size[code] if len(code) else np.zeros(0, np.int64)
        piece_end = np.concatenate([[0], np.cumsum(n)])
        ends = piece_end[np.searchsorted(at, offsets)]  # ids before each row's start and end
        total, rows = int(piece_end[-1]), len(offsets) - 1
        out = np.empty(total + rows, dtype=np.uint32)
        lengths = np.diff(ends) + 1
        row_at = np.concatenate([[0], np.cumsum(lengths)])
        is_end = np.zeros(total + rows, dtype=bool)
        is_end[row_at[1:] - 1] = True
        out[is_end] = END_ID
        if total:
            source = np.repeat(begin[code] - piece_end[:-1], n) + np.arange(total)
            out[~is_end] = flat[source]
        return out, row_at


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
