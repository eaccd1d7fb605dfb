"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Names that the operators use inside; the inputs have columns of these names too.
CLASHES = ["chunk", "ids", "data", "row", "part", "uid", "n", "tokens", "bucket", "digest", "score", "label", "features", "stats", "key", "w", "h", "at", "component_id", "raw", "others", "size", "weight", "fold"]


def frame(spark, rows, doc_id="doc_id", text="text"):
    """A table of (id, text) with columns of clashing names."""
    schema = f"{doc_id} long, {text} string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows], schema)


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, nulls, empties, repeated rows and a long one."""
    r = random.Random(seed)
    syllables = "an er th ou ing re sh le Ma ko ü é 中 xa bo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(30)
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "One TWO"), (6, "a" * 400), (7, "ab " * 300), (8, "line of boiler plate text, more than fifty bytes of it\n" * 20)]
    base = [text(r.randint(20, 200)) for _ in range(8)]
    for i in range(9, n):
        t = r.choice(base) if r.random() < 0.5 else text(r.randint(1, 120))
        if r.random() < 0.5:
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        if r.random() < 0.3:
            t = f"{text(5)} {passage} {text(5)}"
        out.append((i, t))
    out += [(n, text(9000)), out[12], out[12], (None, base[0]), (None, text(40)), (20, text(60))]
    r.shuffle(out)
    return out


def kept(rows, length=50):
    """{(doc_id, text): which of its bytes go}."""
    first: dict[bytes, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, float("inf")), order(i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        out[i, t] = gone
    return out


def left(t, gone):
    return bytes(x for x, g in zip((t or "").encode(), gone, strict=True) if not g)


def removed(rows, length=50):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}."""
    spans = lambda gone: sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
    return {(i, t): (len(gone), sum(gone), spans(gone), hashlib.sha256(left(t, gone)).hexdigest()) for (i, t), gone in kept(rows, length).items()}


def shingles(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def jaccard(rows, width, percent):
    """[(doc_id, n_shingles, component_id)] in the rows' order."""
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(sets[k]), min(least[root(k)], default=None)) for k, (i, _) in enumerate(rows)]


def contaminated(rows, items, width=5, percent=80):
    """{(doc_id, item_id): best similarity} over every window."""
    out: dict = {}
    for i, t in rows:
        w = [x for x in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        for j, text in items:
            v = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
            if not v:
                continue
            k = min(width, len(v))
            of = Counter(tuple(v[p : p + k]) for p in range(len(v) - k + 1))
            for s in range(max(0, len(w) - len(v)) + 1):
                x = w[s : s + len(v)]
                own = Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1))
                o = sum((of & own).values())
                total = sum((of | own).values())
                if o and 100 * o >= percent * total:
                    out[i, j] = max(out.get((i, j), 0), round(o / total, 6))
    return out


def statistics(raw: bytes, weights: dict, second: frozenset, function: frozenset, stems) -> dict:
    """The statistics of one text, byte by byte and word by word."""
    share = lambda a, b: a / b if b else 0.0
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 128
    count = lambda chars: sum(b in chars.encode() for b in raw)
    symbols = "%$&*#@^~_+=<>\\/[]{}`"
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.translate(LOWER) for w in words]
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    said = [w.translate(LOWER) for w in re.findall(rb"[A-Za-z\x80-\xFF]+", raw)]
    text = [w.decode("utf-8", "replace") for w in said]
    weight = [max((weights.get(t, 0.0) for t in ("=" + w.lower(), *(w.lower()[:k] for k in stems if k < len(w.lower())))), default=0.0) for w in text]
    you = [k for k, w in enumerate(said) if w in second]
    n, odd = len(said), [chr(b) in symbols or 48 <= b <= 57 for b in raw]
    shout = lambda w: sum(map(upper, w)) >= 2 and sum(map(upper, w)) * 2 > sum(map(letter, w))
    strong = 0.75 * max(weights.values(), default=1.0)
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "word_length": share(sum(map(len, words)), len(words)),
        "upper": share(sum(map(upper, raw)), sum(map(letter, raw))), "digit": share(count("0123456789"), len(raw)), "mark": share(count(".,;:!?'\"()-"), len(raw)),
        "symbol": share(count(symbols), len(raw)), "pipe": share(count("|"), len(raw)), "exclaim": share(count("!"), len(raw)), "foreign": share(sum(b >= 128 for b in raw), len(raw)),
        "shout_words": share(sum(map(shout, words)), len(words)), "repeat_next": share(sum(a == b for a, b in zip(low, low[1:])), len(words)),
        "distinct_words": share(len(set(low)), len(words)), "top_word": share(max(Counter(low).values(), default=0), len(words)),
        "lines": math.log1p(len(lines)), "repeat_lines": share(len(lines) - len(set(lines)), len(lines)), "short_lines": share(sum(len(x) < 30 for x in lines), len(lines)),
        "function_words": share(sum(w in function for w in text), n),
        "obfuscated": share(sum(odd[k] and letter(raw[k - 1]) and letter(raw[k + 1]) for k in range(1, len(raw) - 1)), len(words)),
        "letter_runs": share(sum(letter(raw[k]) and raw[k] == raw[k - 1] == raw[k - 2] for k in range(2, len(raw))), len(words)),
        "second_person": share(len(you), n), "lexicon": share(sum(weight), n), "lexicon_best": max(weight, default=0.0),
        "lexicon_kinds": math.log1p(len({w for w, x in zip(said, weight) if x})), "lexicon_near_you": share(sum(x > 0 and any(abs(k - y) <= 5 for y in you) for k, x in enumerate(weight)), n),
        "lexicon_strong": share(sum(x for x in weight if x >= strong), n),
    }


def lexicon(sample, stems, support=5, ratio=15.0):
    """{term: log odds} from (text, label) rows."""
    counts, total = (Counter(), Counter()), Counter(y for _, y in sample)
    for t, y in sample:
        words = {w.translate(LOWER).decode("utf-8", "replace").lower() for w in re.findall(rb"[A-Za-z\x80-\xFF]+", t.encode())}
        counts[y].update({x for w in words for x in ("=" + w, *(w[:k] for k in stems if k < len(w)))})
    odds = {t: (k / total[1]) / ((counts[0][t] + 0.5) / total[0]) for t, k in counts[1].items() if k >= support}
    return {t: math.log(o) for t, o in odds.items() if o >= ratio}


def tree_value(node, x):
    """What a Spark tree says of a row of features."""
    while node.numDescendants():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()
