"""The corpus operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import brute

from chronokv.llm import common, components, decontaminate, entry, jaccard, licenses, media, packing, quality, sstable, substrings, textstats, tokens, toxicity, warc

sid = lambda i: -1 if i is None else i


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def rows():
    return brute.corpus(1)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return brute.frame(spark, []).where("false")


# Tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_have_the_ids_of_the_whole_text(rows, name):
    e = tokens.Encoder(tokens.vocabulary(name), keep=50)
    texts = [(t or "").encode() for _, t in rows] + ["foo's don't a b  c　d éè. \t\n q <|endoftext|> 1 22 ÉA x́ (a)b.c, d!e​ f".encode(), "İSTANBUL ΣΑΣ ﬁ 'S".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids, where = e.encode(data, at)
    for i, t in enumerate(texts):
        assert ids[where[i] : where[i + 1]].tolist() == [*e.tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_ids_of_the_library(spark, name):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.vocabulary(name))
    texts = ["end <|endoftext|> start", "<|endoftext|>", "<|startoftext|>A b<|endoftext|><|endoftext|>  c", "x.<|endoftext|>,y  <|EndOfText|> z <|endoftext| >", "é<|endoftext|>é 中<|endoftext|>\n", "<|endof", "text|> a", "", "it<|endoftext|>'s <<|endoftext|>>"]
    want = {i: [*fresh.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert fresh.token_to_id("<|endoftext|>") in want[0]
    raw = [t.encode() for t in texts]
    ids, where = tokens.Encoder(tokens.vocabulary(name)).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    assert {i: ids[where[i] : where[i + 1]].tolist() for i in want} == want
    docs = brute.frame(spark, list(enumerate(texts)))
    crc = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    path = tokens.vocabulary(name)
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, tokenizer=path).collect()} == crc
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in sstable.token_shards(docs, path).collect()} == crc


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    pair = {x: k for k, x in enumerate("abcd ef")} | {"a ": 7, "a b": 8}
    path = str(tmp_path / "plain.json")
    Tokenizer(models.BPE(pair, [("a", " "), ("a ", "b")])).save(path)
    text = b"a ba b"
    ids, _ = tokens.Encoder(path).encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text.decode(), add_special_tokens=False).ids, 1]
    assert all(tokens.Encoder(tokens.vocabulary(n)).cuttable for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_nothing_staged_is_left(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    count = lambda: len(list(root.iterdir())) if root.exists() else 0
    folders, tables = count(), len(spark.catalog.listTables())
    out = substrings.remove_repeats(docs), jaccard.one_of_each(docs), packing.pack(docs)
    assert count() == folders + 4  # the results; of the second what goes and what is there twice
    assert len(spark.catalog.listTables()) == tables and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert all(x.count() for x in out)


# 1


def test_substrings_equal_brute_force(docs, rows):
    want = Counter((i, *brute.removed(rows)[i, t]) for i, t in rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    assert got == want
    assert sum(r[2] for r in want) > 1000


def test_hot_strings_are_split_and_still_right(spark, rows, monkeypatch):
    some = [r for r in rows if r[0] is not None]
    data = b"".join((t or "").encode() for _, t in some)
    at = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in some])])
    for block in (1 << 15, 37):
        monkeypatch.setattr(substrings, "BLOCK", block)
        start, end, row, _ = substrings.minima(np.frombuffer(data, np.uint8), at)
        assert (np.diff(at).clip(49) - 49).sum() == (end - start).sum()  # every string start is in one run
        assert (end + 49 <= at[row + 1]).all() and (start >= at[row]).all()
    want = Counter((i, *brute.removed(rows)[i, t]) for i, t in rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(brute.frame(spark, rows).repartition(4), hot_class=1).collect())
    assert got == want


def test_cut_texts_keep_their_columns(docs, rows):
    want = {i: t for i, t in rows}
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    assert all((r.text is None) == (want[r.doc_id] is None) for r in got if r.doc_id in (0, 1, 2, 3))
    assert all(r.chunk == "x" for r in got)


def test_cut_texts_keep_every_type(spark):
    import datetime
    from decimal import Decimal

    passage = "a passage of more than fifty bytes that two documents have in common, word by word"
    schema = "doc_id long, text string, n_chars double, m map<int,string>, d decimal(30,9), t timestamp, u timestamp_ntz, b binary, a array<struct<x:float,y:date>>, absent string, c0 int"
    row = lambda i, t: (i, t, float("nan"), {1: "x", 2: None}, Decimal("123456789012345678901.000000001"), datetime.datetime(1969, 1, 2, 3, 4, 5, 678901), datetime.datetime(2030, 1, 2, 3, 4, 5, 6), b"\0\xff", [(1.5, datetime.date(1, 1, 1)), None], None, -i)
    rows = [row(1, passage), row(2, f"before {passage} after"), row(3, None)]
    df = spark.createDataFrame(rows, schema)
    out = substrings.without_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    plain = lambda d: sorted(map(str, d.drop("text").collect()))
    assert plain(out) == plain(df)
    assert {r.doc_id: r.text for r in out.collect()} == {1: passage, 2: "before  after", 3: None}
    assert substrings.without_repeats(df.where("false")).count() == 0


def test_suffix_array_is_sorted(rows):
    strings = sorted({(t or "").encode()[:150] for _, t in rows if t and len(t) > 60})
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    raw = text.tobytes()
    assert substrings.suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_matching_statistics_of_foreign_texts():
    """Patterns that the index does not hold: at each place the longest match with the text, up to the bound."""
    r = np.random.default_rng(4)
    for letters in (2, 5):
        base = r.integers(97, 97 + letters, 40).astype(np.uint8)
        text = np.append(np.concatenate([np.concatenate([base[: r.integers(5, 40)], r.integers(97, 97 + letters, 3)]) for _ in range(30)]).astype(np.uint8), np.uint8(255))
        index, raw = substrings.RunIndex(text), text.tobytes()
        patterns = np.concatenate([np.concatenate([base[k : k + 25], r.integers(96, 98 + letters, 4)]) for k in range(12)]).astype(np.uint8)
        edges = np.concatenate([[0], np.cumsum(r.integers(1, 40, 6)), [len(patterns)]])
        edges = np.unique(np.minimum(edges, len(patterns)))
        seen = 0
        for which, place, row, stat in index.stream(edges[:-1], edges[1:], patterns, 64):
            for w, p, s in zip(which, place, stat, strict=True):
                want = max(k for k in range(int(edges[w + 1]) - int(p) + 1) if patterns[p : p + k].tobytes() in raw)
                assert s == want
                seen += 1
        assert seen == len(patterns)


def test_index_is_of_the_runs_size():
    """Fifty near copies of one text: what is kept grows with the runs and not with the text, but for the text itself."""
    r = np.random.default_rng(6)
    base = r.integers(97, 122, 2000).astype(np.uint8)
    sizes = []
    for copies in (5, 50):
        some = []
        for _ in range(copies):
            own = base.copy()
            own[r.integers(0, 2000)] = 122
            some.append(np.append(own, np.uint8(255)))
        index = substrings.RunIndex(np.concatenate(some), lambda sa: sa * 0)
        arrays = [v for k, v in vars(index).items() if isinstance(v, np.ndarray) and k not in ("text", "eight")]
        assert all(len(v) <= index.runs for v in arrays)
        sizes.append(index.runs)
    assert sizes[1] < 2 * sizes[0] and sizes[1] < 0.1 * index.n


def test_smallest_owner_of_pieces():
    r = np.random.default_rng(7)
    base = bytes(r.integers(97, 103, 400).astype(np.uint8))
    texts = [base[r.integers(0, 100) : r.integers(200, 400)] + bytes(r.integers(97, 103, 60).astype(np.uint8)) for _ in range(25)] + [base, base[10:300]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, row, _ = substrings.minima(data, at)
    low: dict = {}
    high: dict = {}
    best: dict = {}
    for a, b, d in zip(start, end, row, strict=True):
        piece = data[a : b + 49].tobytes()
        low[piece], high[piece] = min(low.get(piece, d), d), max(high.get(piece, d), d)
        for k in range(len(piece) - 49):
            best[piece[k : k + 50]] = min(best.get(piece[k : k + 50], d), d)
    pieces = sorted(low)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    least, where = substrings.smallest_owner(np.frombuffer(b"".join(pieces), np.uint8), offsets, np.array([low[x] for x in pieces]), np.array([high[x] for x in pieces]))
    for i, x in enumerate(pieces):
        assert least[where[i] : where[i + 1]].tolist() == [best[x[k : k + 50]] for k in range(len(x) - 49)]


def test_owners_are_the_same_lot_by_lot(monkeypatch):
    r = np.random.default_rng(8)
    base = bytes(r.integers(97, 123, 3000).astype(np.uint8))
    texts = [base[a : a + r.integers(50, 400)] + bytes(r.integers(97, 123, 60).astype(np.uint8)) for a in np.sort(r.integers(0, 2900, 40))]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    start, end, row, _ = substrings.minima(data, at)
    low: dict = {}
    for a, b, d in zip(start, end, row, strict=True):
        low.setdefault(data[a : b + 49].tobytes(), r.permutation(40)[d])
    pieces, low = np.frombuffer(b"".join(low), np.uint8), (np.concatenate([[0], np.cumsum([len(x) for x in low])]), np.array([*low.values()]))
    owners = []
    for lot in (1 << 30, 200):
        monkeypatch.setattr(substrings, "LOT", lot)
        owners.append(substrings.smallest_owner(pieces, *low, low[1] + 5)[0])
    assert (owners[0] == owners[1]).all() and (owners[0] < np.repeat(low[1], np.diff(low[0]) - 49)).any()


def test_repeats_need_few_messages_at_any_size():
    for text in (10 << 30, 50 << 30):  # 6 and 30 GB of Parquet
        chunk, bucket = substrings.portion(text, substrings.CHUNK_BYTES, substrings.MOST_CHUNK), substrings.portion(text, substrings.LEAST_BUCKET, substrings.MOST_BUCKET)
        assert max(chunk, bucket) <= 16 << 20  # bytes that a task holds at once
        messages = text / chunk * 2 ** substrings.bits_for(text, bucket)
        assert text / messages > 2500  # bytes of text for each; 512 and 102 before, with chunks of 4 MB and buckets of 2 MB
    data = np.random.default_rng(9).integers(97, 123, 200_000).astype(np.uint8)
    key = substrings._keys(50, 26)(data, np.array([0, len(data)]))[1]
    assert np.bincount((key >> np.uint64(58)).astype(np.int64), minlength=64).max() < 3 * len(key) / 64  # buckets are alike; the first had a third before


# 2


def test_packing_loses_nothing(docs, rows):
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        want.update((i, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].astype("<u4").tobytes()), len(ids)) for k in range(0, len(ids), 2048))
    packed = packing.pack(docs).cache()
    got = packed.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) == -(-total // 2048)
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) // 2 for r in whole) == total


def test_fullest_is_the_best_subset():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(60):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(4)}
        items = [x for x, n in counts.items() for _ in range(n)]
        must = max(items)
        best = max(s for k in range(1, len(items) + 1) for c in itertools.combinations(items, k) if must in c and (s := sum(c)) <= 40)
        taken = packing.fullest(counts, 40)
        assert sum(x * k for x, k in taken.items()) == best
        assert all(k <= counts[x] for x, k in taken.items())


def test_plan_uses_every_piece():
    histogram = {x: (x * 7919) % 97 for x in range(1, 2049)}
    used = Counter()
    for pattern, times in packing.plan(histogram, 2048):
        assert sum(x * k for x, k in pattern.items()) <= 2048
        used.update({x: k * times for x, k in pattern.items()})
    assert used == Counter({x: n for x, n in histogram.items() if n})
    assert packing.padding(histogram, 2048) < 0.02 * sum(x * n for x, n in histogram.items())


# 3


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(docs, rows, width, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width, percent).collect())
    assert got == Counter(brute.jaccard(rows, width, percent))


def test_split_blocks_lose_no_link(spark):
    import random

    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randrange(12)}"
        rows.append((i, " ".join(w)))
    sets = jaccard.sets(brute.frame(spark, rows), 3, 80).where("tokens is not null").dropDuplicates(["signature"])
    found = components.components(jaccard.links(common.stage(sets, "sets"), 80, part=8))
    label = {x.node: x.component for x in found.collect()}
    uid = {x.uid: x.doc_id for x in sets.collect()}
    mine = defaultdict(set)
    for u, d in uid.items():
        mine[label.get(u, u)].add(d)
    kept = sorted(uid.values())
    want = defaultdict(set)
    for d, (_, _, c) in zip(kept, brute.jaccard([rows[d] for d in kept], 3, 80), strict=True):
        want[c].add(d)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_one_of_each_removes_rows_and_not_identifiers(spark):
    same, other = "a b c d e f g h", "quite another text of some words"
    rows = [(5, same), (3, same), (9, same.upper()), (4, other), (None, same), (6, None), (3, "z y x w v u"), (None, "k l m n o p q"), (None, "k l m n o p q"), (4, other)]
    left = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(brute.frame(spark, rows).repartition(3)).collect())
    assert left == Counter([(3, same), (4, other), (6, None), (3, "z y x w v u"), (None, "k l m n o p q")])
    rows = [(1, "A a a a a a"), (2, "A a a a a a"), (2, "B b c d e f"), (None, "B z c d e f"), (None, "other words here that stand alone")]
    assert {(r.doc_id, r.text) for r in jaccard.one_of_each(brute.frame(spark, rows)).collect()} == {rows[0], *rows[2:]}


def test_subtrees_are_skipped_whole():
    r = np.random.default_rng(2)
    # Two families with long common beginnings: sets of one never link with those of the other, nor short ones with long ones.
    tokens, n = [], []
    for family, size in ((0, 40), (1000, 200)):
        for k in range(30):
            own = np.sort(r.choice(20, 2, replace=False)) + 5000 * (k + 1) + family
            tokens.append(np.concatenate([np.arange(size) + family, own]).astype(np.uint64))
            n.append(size + 2 if k % 2 else 3 * size)
    visited: list[int] = []
    got = jaccard.trie_join(np.array(n), tokens, 90, visited=visited)
    sets, want = [set(t.tolist()) for t in tokens], list(range(60))
    for a in range(60):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 90 * (n[a] + n[b] - o):
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    assert got.tolist() == want
    everything: list[int] = []
    jaccard.trie_join(np.array(n), tokens, 1, visited=everything)
    assert len(visited) < 60 < len(everything) + 60 and visited.count(1) < 60


# 4


def test_media_round_trip(docs, rows):
    def described(t):
        raw = (t or "").encode()
        p = media.padded(raw)
        assert len(p) % 64 == 0 and p
        share = [p.count(k) / len(p) for k in range(256)]
        mean = sum(k * x for k, x in enumerate(share))
        std = sum(x * (k - mean) ** 2 for k, x in enumerate(share)) ** 0.5
        entropy = -sum(x * math.log2(x) for x in share if x)
        step = sum(abs(a - b) for a, b in zip(p, p[1:])) / (len(p) - 1)
        stored = media.to_png(p, len(raw))
        return (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(p) // 64, mean, std, entropy, step)

    lines = lambda t: [" ".join(x.split()) for x in (t or "").split("\n") if x.split()]
    got, want = [], []
    for r in media.media_columns(docs).collect():
        assert r.caption == f"document {'null' if r.doc_id is None else r.doc_id}"
        height, numbers = r.feature.split("x64 ")
        got.append((sid(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, int(height), *(float(x.split("=")[1]) for x in numbers.split()), r.position, r.n_items, r.text_chars))
    for i, t in rows:
        first = bool((t or "").split("\n")[0].split())
        want.append((sid(i), *described(t), int(first), len(lines(t)) + 1, sum(map(len, lines(t)))))
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:7] == b[:7] and a[7:] == pytest.approx(b[7:], abs=6e-5)


def test_pages_are_whole_and_in_order(docs, rows):
    with common.scratch(docs.sparkSession):
        store = media.store_texts(docs)
        out = defaultdict(list)
        for r in media.items(store, row="row").orderBy("row", "position").collect():
            out[r.row].append((r.doc_id, r.position, r.kind, r.text, r.digest))
        digest = {r.row: r.digest for r in store.select("row", "digest").collect()}
    got = Counter()
    for row, parts in out.items():
        assert [p[1] for p in parts] == list(range(len(parts)))
        assert [p[4] for p in parts if p[2] == "media"] == [digest[row]]
        got[parts[0][0], " ".join(p[3] for p in parts if p[2] == "text")] += 1
    assert got == Counter((i, " ".join((t or "").split())) for i, t in rows)


def test_raw_pages_are_resolved(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    want = Counter((p, k, x["kind"], x["text"], x["ref"], x["caption"]) for p, h in html.items() for k, x in enumerate(media.parse(h)))
    assert sum(want.values()) > len(html)
    refs = sorted({w[4] for w in want if w[4]}) or ["none"]
    store = spark.createDataFrame([(r, len(r)) for r in refs[::2]], "digest string, size int")
    got = media.page_sequences(pages, store).collect()
    assert Counter((r.doc_id, r.position, r.kind, r.text, r.digest, r.caption) for r in got) == want
    assert all(r.size == (len(r.digest) if r.digest in refs[::2] else None) for r in got)


def test_interleaved_sequence(spark):
    html = '<p>Hello <b>you</b></p><script>var x="<p>no</p>"</script><figure><img src="media:sha256:aa"><img src="b.png"><figcaption>two &amp; more</figcaption></figure>tail<img src="c" alt="alone"><figcaption>stray'
    got = [(x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse(html)]
    assert got == [("text", "Hello you", None, None), ("media", None, "media:sha256:aa", "two & more"), ("media", None, "b.png", "two & more"), ("text", "tail", None, None), ("media", None, "c", "alone"), ("text", "stray", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (None, "<p>x")], "doc_id long, html string")
    store = spark.createDataFrame([("aa", "found", 7)], "digest string, text string, extra int")
    for hot in (1, 1000):
        with common.scratch(spark):
            out = {(r.doc_id, r.position): r for r in media.resolve(common.stage(media.items(pages), "items"), store, hot).collect()}
        assert out[1, 1].media_text == "found" and out[1, 2].extra is None and out[1, 2].caption == "two & more" and (None, 0) in out
    with common.scratch(spark):
        odd = media.resolve(media.items(pages), spark.createDataFrame([("aa", "a", "b")], "digest string, text string, media_text string"))
        assert len(set(odd.columns)) == len(odd.columns)
    assert out[1, 1].media_text == "found" and out[1, 2].extra is None and out[1, 2].caption == "two & more" and (None, 0) in out
    blob = media.to_png(media.padded(b"abc"), 3)
    assert media.from_png(blob) == (media.padded(b"abc"), 3)
    with pytest.raises(ValueError):
        media.from_png(blob[:45] + b"\0" + blob[46:])


# 5 and 10


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return common.table(spark, sf, "documents"), common.table(spark, sf, "labels")


@pytest.mark.parametrize(("run", "label", "least"), [(toxicity.toxicity, "toxic", 0.9), (quality.quality, "quality", 0.9)])
def test_held_out_accuracy(labelled, run, label, least):
    d, labels = labelled
    out = run(d, labels).join(labels, "doc_id").collect()
    held = sorted((r.score, r[label]) for r in out if r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= least, auc


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_scores_without_labels(docs, rows, spark, run):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs, labels).count() == len(rows)
    assert run(docs.where("false"), labels).count() == 0
    assert run(docs, spark.createDataFrame([(9, 1, 1), (9, 0, 0), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")).where("score is null").count() == 0


def test_statistics_of_edges():
    texts = [b"", b" ", b"A", "é".encode(), b"you idiot, YOU id1ot!!", b"a a a a\na a a a\n", b"x" * 5000]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = textstats.statistics(np.frombuffer(b"".join(texts), np.uint8), at, textstats.Lexicon({"=idiot": 2.0}))
    assert np.isfinite(whole).all() and whole.shape == (len(texts), len(textstats.NAMES))
    for i, t in enumerate(texts):  # a text's row does not depend on its neighbours
        alone = textstats.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]), textstats.Lexicon({"=idiot": 2.0}))
        assert np.allclose(alone[0], whole[i]), t
    assert whole[4][textstats.NAMES.index("lexicon_near_you")] > 0 and whole[4][textstats.NAMES.index("obfuscated")] > 0


def _texts(seed: int, n: int) -> list[str]:
    import random

    r = random.Random(seed)
    words = "you YOU your stupid stup1d idiot idiots IDIOT!! the and of Haus für é éclair aaa aa a 1a a1 x$y | <b> [] don't ... 中中中 \t\t zz-top e3e WOW".split(" ")
    text = lambda: "".join(r.choice(words) + r.choice([" ", "  ", "\n", "", ", ", "\n\n"]) for _ in range(r.randint(0, 60)))
    return ["", " ", "aa", "a1", "b", "a", *(text() for _ in range(n)), "line\nline\nline", "x" * 900]


def test_statistics_equal_plain_ones():
    texts = [t.encode() for t in _texts(1, 60)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weights = {"=idiot": 3.0, "idiot": 2.0, "stupi": 1.0, "=é": 0.5}
    for own in (weights, {}):
        got = textstats.statistics(np.frombuffer(b"".join(texts), np.uint8), at, textstats.Lexicon(own))
        for i, t in enumerate(texts):
            want = brute.statistics(t, own, textstats.SECOND, textstats.FUNCTION, textstats.STEMS)
            assert dict(zip(textstats.NAMES, got[i].tolist(), strict=True)) == pytest.approx(want, abs=1e-12), t


def test_lexicon_equals_plain_counts(spark):
    texts = _texts(2, 200)
    sample = [(t, int("idiot" in t.lower() and k % 3 > 0)) for k, t in enumerate(texts)]
    with common.scratch(spark):
        got = toxicity.learn_lexicon(spark.createDataFrame(sample, "text string, label int").repartition(3), ratio=1.5)
    assert got == pytest.approx(brute.lexicon(sample, textstats.STEMS, ratio=1.5)) and len(got) > 3


def test_scores_equal_plain_ones(labelled):
    """Trees, calibration and rules, applied by hand to statistics computed by hand."""
    d, labels = labelled
    spark = d.sparkSession
    some = [r.text for r in d.limit(60).collect()] + _texts(3, 20)
    texts = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    of = lambda t, w: [x for _, x in sorted(((textstats.NAMES.index(k), v) for k, v in brute.statistics(t.encode(), w, textstats.SECOND, textstats.FUNCTION, textstats.STEMS).items()))]
    with common.scratch(spark):
        model = toxicity.fit(d, labels)
        got = {r.doc_id: r.score for r in model.score(texts, ["doc_id"]).collect()}
        roots = [t._call_java("rootNode") for t in model.trees.trees]
        bounds, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
        for i, t in enumerate(some):
            x = of(t, model.weights)
            margin = sum(w * brute.tree_value(n, x) for w, n in zip(model.trees.treeWeights, roots, strict=True))
            raw = 1 / (1 + math.exp(-2 * margin))
            want = min(1.0, max(0.0, 0.999 * np.interp(raw, bounds, values) + 0.001 * raw))
            assert got[i] == pytest.approx(want, abs=1e-9), i
        ensemble = quality.fit(d, labels)
        assert 0 < len(ensemble.rules) < 24 * 14
        got = {r.doc_id: r.score for r in textstats.with_statistics(texts).withColumn("score", ensemble.score()).collect()}
        for i, t in enumerate(some):
            x = of(t, {})
            total = ensemble.intercept + sum(w for rule, w in ensemble.rules if all(x[k] <= b if most else x[k] > b for k, most, b in rule.parts))
            assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), i


def test_rules_are_conjunctions(spark):
    rule = quality._shortened([(0, True, 5.0), (0, True, 3.0), (1, False, 1.0), (1, False, 2.0)])
    assert rule.parts == ((0, True, 3.0), (1, False, 2.0))
    df = spark.createDataFrame([([2.0, 3.0],), ([4.0, 3.0],), ([2.0, 2.0],)], "stats array<double>")
    assert [r[0] for r in df.select(rule.column()).collect()] == [True, False, False]


# 6


def test_licenses_and_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\n"), ("a/b/d.py", "nothing"), ("a/b/LICENSE.txt", None), ("e.py", ""), ("f/g.py", "the of and in is"), (None, "Licensed under CC BY-NC 4.0."), ("a/b/d.py", "nothing"), ("a/h/i/j.py", None)]
    df = spark.createDataFrame([(p, t, 1, "x", "y") for p, t in files], "path string, text string, row int, license_ string, term string")
    got = {(r.path, r.license, r.inherited_from, r.effective_license) for r in licenses.scan(df).collect()}
    assert got == {("a/LICENSE", "MIT", None, "MIT"), ("a/b/c.py", "Apache-2.0", None, "Apache-2.0"), ("a/b/d.py", None, "a", "MIT"), ("a/b/LICENSE.txt", None, "a", "MIT"), ("e.py", None, None, None), ("f/g.py", None, None, None), (None, "CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), ("a/h/i/j.py", None, "a", "MIT")}
    assert licenses.scan(df).count() == len(files)
    assert licenses.scan(df.where("false")).count() == 0


def test_whole_licence_files_are_known(spark):
    texts = dict(licenses.TEXTS)
    holder = "Copyright (c) 1999 Some Holder and Another Holder\n\n"
    notice = "words of a long README " * 50 + "\nLicensed under the Apache License, Version 2.0.\n" + "more words " * 80
    files = [*((f"{n}/LICENSE", holder + t) for n, t in texts.items()), ("MIT/src/main.c", "int main;"), ("x/NOTICE", notice), ("x/y/z", "z"), ("no/whole.txt", texts["MIT"].replace("\n", " "))]
    df = spark.createDataFrame([(p, t, "mine", 0.5) for p, t in files], "path string, text string, license string, similarity double")
    out = {r.path: r for r in licenses.scan(df).collect()}
    assert {n: out[f"{n}/LICENSE"]["_license"] for n in texts} == {n: n for n in texts}
    assert (out["MIT/src/main.c"].inherited_from, out["MIT/src/main.c"].effective_license) == ("MIT", "MIT")
    assert out["x/NOTICE"]["_license"] == out["x/y/z"].effective_license == "Apache-2.0"  # by a line of the file
    assert out["x/y/z"].license == "mine" and out["x/y/z"].similarity == 0.5 and out["x/y/z"]["_similarity"] is None
    with common.scratch(spark):
        common.stage(licenses.scan(df), "written")


def test_telling_terms_miss_nothing():
    marks = set(licenses.telling(licenses.TEMPLATES, 0.6))
    rest: dict = defaultdict(float)
    for i, _, t, x in licenses.vectors(licenses.TEMPLATES):
        rest[i] += 0 if t in marks else x * x
    assert max(rest.values()) < 0.36


# 7


def test_shards_round_trip(spark, docs, rows, empty):
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    got = sstable.token_shards(docs).orderBy("start").collect()
    ids = lambda t: np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    assert [sid(r.doc_id) for r in got] == sorted(sid(i) for i, _ in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert sstable.token_shards(empty).count() == 0


def test_lookup_by_block():
    w = sstable.Writer(block=256)
    for k in range(500):
        w.add(sstable.key_of(3 * k - 700, k), np.arange(k % 9, dtype=np.uint32))
    r = sstable.Reader(pa.BufferReader(w.finish()))
    assert r.blocks > 10
    for k in range(500):
        before = r.blocks_read
        assert [ids.tolist() for _, ids in r.find(3 * k - 700)] == [list(range(k % 9))]
        assert r.blocks_read - before <= 2
    assert not [x for i in (1, 10**9, None) for x in r.find(i)]
    with pytest.raises(ValueError):
        w2 = sstable.Writer()
        w2.add(b"b", np.zeros(1)), w2.add(b"a", np.zeros(1))


def test_lookup_over_shards(spark, rows):
    from tokenizers import Tokenizer

    repeated = [*rows, *[(20, f"again {k} " * 30) for k in range(40)]]
    fresh = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = lambda t: (*fresh.encode(t or "", add_special_tokens=False).ids, 1)
    with common.scratch(spark) as here:
        manifest = sstable.write_shards(brute.frame(spark, repeated), f"{here.root}/shards", shard_bytes=800, block=300)
        assert manifest.count() > 10
        wanted = [20, None, 12, 10**12, 0]
        got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in sstable.lookup(manifest, wanted).collect())
        assert got == Counter((i, ids(t)) for i, t in repeated if i in wanted)
        assert sstable.lookup(manifest, []).count() == 0
        starts = [r.base for r in sstable.bases(manifest).join(manifest, "uri").orderBy("part", "shard").collect()]
        assert starts == np.concatenate([[0], np.cumsum([r.n_ids for r in manifest.orderBy("part", "shard").collect()])])[:-1].tolist()


# 8


def test_windows_equal_brute_force(spark):
    import random

    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(j, " ".join(text(r.choice([1, 3, 4, 5, 6, 20, 40, 60])))) for j in range(25)] + [(90, None), (91, ""), (92, "w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(150):
        w = text(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            v = (r.choice(items)[1] or "").split()
            for _ in range(r.randint(0, 2)):
                if v:
                    k = r.randrange(len(v))
                    v = r.choice([v[:k] + v[k + 1 :], [*v[:k], "new", *v[k:]], [*v[:k], "other", *v[k + 1 :]]])
            p = r.randint(0, len(w))
            w = w[:p] + v + w[p:]
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (None, items[6][1]), (1002, "w1 " * 50), rows[3]]
    benchmark = brute.frame(spark, items, "item_id")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(brute.frame(spark, rows), benchmark).collect()}
    want = brute.contaminated(rows, items)
    assert got == want and len(want) > 30
    texts = {(i, t) for i, t in rows if not brute.contaminated([(0, t)], items)}
    rows.append((3, "clean words that no item has"))
    left = decontaminate.uncontaminated(brute.frame(spark, rows), benchmark)
    assert left.columns == brute.frame(spark, rows).columns
    assert Counter((x.doc_id, x.text) for x in left.collect()) == Counter(r for r in rows if r in texts or r == rows[-1])


def test_recall_near_the_threshold(spark):
    """Of windows edited to a similarity just above the threshold the multi-index loses none."""
    import random

    r = random.Random(11)
    items = [(j, " ".join(f"i{j}w{r.randrange(900)}" for _ in range(r.randint(40, 120)))) for j in range(60)]
    rows, want = [], {}
    for i in range(600):
        j = i % 60
        w = items[j][1].split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(["before"] * (i % 7) + w + ["after"] * (i % 5))))
        want |= {(i, j): s for (_, _), s in brute.contaminated([(i, rows[-1][1])], [items[j]]).items()}
    close = {k for k, s in want.items() if s < 0.85}
    assert len(close) > 40
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(brute.frame(spark, rows), brute.frame(spark, items, "item_id")).collect()}
    assert got == want


def test_candidates_do_not_multiply_with_the_benchmark(spark):
    """Items of one length meet only the windows that hold their own rare shingles."""
    import random

    r = random.Random(12)
    items = [(j, " ".join(f"w{r.randrange(5000)}" for _ in range(50))) for j in range(200)]
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(100)) + " " + items[i][1]) for i in range(50)]
    written: list = []
    found = decontaminate.similar_texts(brute.frame(spark, rows), brute.frame(spark, items, "item_id"), prints=written)
    assert found.count() == 50
    windows, candidates = (t.count() for t in written)
    assert candidates <= windows < 50 * 30


def test_windows_of_any_start_are_found(spark):
    v = [f"v{k}" for k in range(400)]
    # Halves swapped; two words changed at each end and four put in the middle: the best window starts where no shared shingle aligns the item.
    edited = {j: ["x1", "x2", *w[2 : n // 2], "y1", "y2", "y3", "y4", *w[n // 2 : -2], "x3", "x4"] for j, n in ((1, 76), (2, 80), (3, 90)) if (w := v[:n])}
    items = [(0, " ".join(v[300:360])), *((j, " ".join(v[:n])) for j, n in ((1, 76), (2, 80), (3, 90)))]
    around = [f"a{k}" for k in range(40)]
    rows = [(0, " ".join([*around, *v[330:360], *v[300:330], *around])), *((j, " ".join([*around, *w, *around])) for j, w in edited.items())]
    want = brute.contaminated(rows, items)
    assert {(0, 0), (1, 1), (2, 2), (3, 3)} <= set(want)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(brute.frame(spark, rows), brute.frame(spark, items, "item_id")).collect()}
    assert got == want


# 9


def test_archive_equals_rule(spark):
    pages = [(3, "u", "x"), (1, "http://a b", "x"), (2, None, "é"), (7, "v", None), (8, "v", ""), (9, "w", "y" * 300_000), (None, "n", "x"), (4, "q", "y" * 300_000), (5, "r", "\r\n\r\nWARC/1.1\r\n"), (None, "a", "lost"), (None, "b", "lost"), (6, "c", "twin"), (6, "d", "twin")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, row string, n_bytes int").repartition(3)
    for least in (0, 2):
        order = lambda p: (p[0] is None, p[0] or 0)
        want, seen = Counter(), {}
        for i, _, h in sorted(pages, key=order):
            raw = (h or "").encode()
            again = len(raw) >= least and raw in seen
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", seen[raw] if again else None] += 1
            seen.setdefault(raw, i)
        assert Counter(map(tuple, warc.archive(df, least).collect())) == want
    assert warc.archive(df.drop("url")).count() == len(pages)


def test_records_are_found_by_identifier(spark):
    pages = [(k % 50 or None, f"http://x/{k}", f"page {k // 2} " * 40) for k in range(300)]
    with common.scratch(spark) as here:
        record_map = warc.write_bundles(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), f"{here.root}/warc", bundle_bytes=3000, group=1000)
        rows = record_map.collect()
        assert len({r.record_id for r in rows}) == 300 and len({r.uri for r in rows}) > 4
        wanted = spark.createDataFrame([(r.record_id,) for r in rows[::7]] + [("urn:uuid:none",)], "record_id string")
        got = {r.record_id: r for r in warc.lookup(record_map, wanted).collect()}
        assert set(got) == {r.record_id for r in rows[::7]}
        every = {r.record_id: r for r in warc.read_bundles(record_map).collect()}
        assert all(every[k] == r for k, r in got.items())
        assert all((every[r.refers_to_record].payload_digest, every[r.refers_to_record].record_type) == (r.payload_digest, "response") for r in every.values() if r.record_type == "revisit")


def test_frames_are_seekable():
    import zstandard

    b = warc.Bundle(group=500)
    places = [b.add(warc.record("response", k, k, f"http://x/{k}", b"z" * k, "D", k, None)) for k in range(40)]
    blob = b.finish()
    file = pa.BufferReader(blob)
    table = warc.seek_table(file)
    for k, (f, at) in enumerate(places):
        head, payload, _ = warc.parse(warc.frame(file, f, table), at)
        assert payload == b"z" * k and head["WARC-Page-ID"] == str(k)
    plain = zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1") == 40


# Empty tables


@pytest.mark.parametrize("run", [substrings.remove_repeats, substrings.without_repeats, packing.pack, jaccard.jaccard_components, jaccard.one_of_each, media.media_columns])
def test_empty_tables_give_no_rows(empty, run):
    assert run(empty).count() == 0


def test_empty_pages_and_items(spark, docs, empty):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontaminate.contaminated(docs, brute.frame(spark, [], "item_id")).count() == 0
    assert decontaminate.contaminated(empty, brute.frame(spark, [(1, "a b c d e f")], "item_id")).count() == 0


# Queries with SQL


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    from oracle import connect, differences

    assert not differences(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], connect(sf_dir))
