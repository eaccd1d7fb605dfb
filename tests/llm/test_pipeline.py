"""The pipeline's stages, each held against brute force on what it was given."""

import sys
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

import corpus_pipeline
from chronokv.llm import common, tokens


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    toxic = {r.doc_id for r in common.table(spark, sf_dir, "labels").collect() if r.toxic}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = common.stage(f(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        rows = out.collect()
        now = {r.doc_id: r.text for r in rows}
        gone = set(kept) - set(now)
        if name == "toxicity":
            assert len(gone - toxic) <= 0.1 * len(kept)
        elif name == "jaccard":
            assert gone == {i for i, _, c in brute.jaccard(sorted(kept.items()), 5, 80) if i != c}
        elif name == "substrings":
            want = brute.kept(sorted(kept.items()))
            assert now == {i: None if t is None else brute.left(t, want[i, t]).decode("utf-8", "ignore") for i, t in kept.items()}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        else:
            assert gone == {i for i, _ in brute.contaminated(sorted(kept.items()), items)}
        docs, kept = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert len({key(r)[:2] for r in packed}) == len(packed)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(key(r)[:4] for r in whole) == sorted(key(r)[:4] for r in packed)
    tokenizer = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in kept.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in packed) == sorted((i, k, len(x[k : k + 2048]), len(x), crc(x[k : k + 2048])) for i, x in ids.items() for k in range(0, len(x), 2048))
    ends: dict = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(map(len, ids.values())) // 2048) + 1
