"""N-gram Jaccard join by a prefix tree.

A document's set is its distinct word shingles, in one global order: commonest first (by the
class of the shingle's document count), then by hash. Shingles of one document only can match
nothing, so they are counted but not kept; a document of which too few are left to reach the
threshold has no partner and goes no further. Equal sets are represented by one document.

Two linked sets share one of their rarest shingles (the prefix filter), so the components of
"shares a rare shingle" are blocks that no link leaves. A block's sets are stored in a trie and
joined by one walk over it: documents with a common path share the overlaps counted along it,
and a whole subtree is skipped when the largest remaining length and the smallest set below it
allow no link to a set that is not connected with all of it yet. Large blocks are split and their parts joined in pairs; what the first parts
have connected is not compared again, and what they have not is compared with everything.

Shingles are compared by 56 bits of a 64-bit hash within one class of document counts, never by
their text; two different shingles of one pair of sets agree with a chance of about 1e-11.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.chunks import NULL_ID, bucket_bits, chunked, classes_of, count_classes, distinct_pairs, expand, key_counts, opened, others_of, rows_of
from chronokv.llm.common import LOWER, checked_broadcast, finished, fresh, scratch, settled, shingle_hashes, stage, text_key, tidy
from chronokv.llm.components import components

PART = 512  # documents in a part of a split block
SENT = 500_000  # rows of three numbers that are sent to all tasks that read documents


def _keys(width: int):
    def keys_of(data, offsets):
        key, row = shingle_hashes(LOWER[data], offsets, width)
        return distinct_pairs(row, key)

    return keys_of


def sets(docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(uid, doc_id, n, signature, tokens): tokens are null where no other set can reach the threshold.

    ``uid`` numbers the rows; ``tokens`` are the kept shingles as ordered 64-bit numbers. ``keep``
    names columns of numbers that stay with the rows, as k0, k1 and so on.
    """
    chunks = chunked(docs, doc_id, text, others=keep)
    kept_too = [f"k{i}" for i in range(len(keep or []))]
    bits = bucket_bits(chunks)
    shared = count_classes(chunks, _keys(width), bits)

    def build(batches):
        for x in rows_of(batches):
            data, offsets, ids = opened(x)
            row, key = _keys(width)(data, offsets)
            keys, _ = key_counts(key)
            kind = classes_of(keys, x["parts"], bits)[np.searchsorted(keys, key)]
            at = np.searchsorted(row, np.arange(len(ids) + 1))
            n = np.diff(at)
            common = np.concatenate([[0], np.cumsum(kind > 0)])
            kept = np.diff(common[at])
            alive = (n > 0) & (100 * kept >= percent * n)
            token = ((np.uint64(255) - kind.astype(np.uint64)) << np.uint64(56)) | (key >> np.uint64(8))
            out, signature = [], []
            for i in range(len(ids)):
                if alive[i]:
                    own = slice(at[i], at[i + 1])
                    out.append(np.sort(token[own][kind[own] > 0]).tobytes())
                    signature.append(hashlib.blake2b(key[own].tobytes(), digest_size=16).digest())
                else:
                    out.append(None)
                    signature.append(None)
            more = others_of(x).columns if keep else []
            yield pa.RecordBatch.from_arrays([pa.array(expand(x["uids"], np.int64)), pa.array(ids, mask=ids == NULL_ID), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.array(out, pa.binary()), *more], names=["uid", "doc_id", "n", "signature", "tokens", *kept_too])

    joined = chunks.join(shared.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "uids", "offsets", "body", "others", "parts")
    return stage(joined.mapInArrow(tidy(build), "uid long, doc_id long, n long, signature binary, tokens binary" + "".join(f", {c} long" for c in kept_too)), "sets")


def rare_tokens(representatives: DataFrame, percent: int) -> DataFrame:
    """(token, uid) of each set's rarest shingles, one of which any linked set has among its own."""

    def cut(batches):
        for batch in batches:
            uid, token = [], []
            for u, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                prefix = n - -(-percent * n // 100) + 1 - (n - len(own))
                take = own[max(0, len(own) - prefix) :]
                token.append(take.astype(np.int64))
                uid.append(np.full(len(take), u, np.int64))
            if uid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(uid))], names=["token", "uid"])

    return representatives.select("uid", "n", "tokens").mapInArrow(tidy(cut), "token long, uid long")


def trie_join(n: np.ndarray, tokens: list[np.ndarray], percent: int, left: np.ndarray | None = None, visited: list[int] | None = None) -> np.ndarray:
    """For each set the smallest index that it is connected with through links.

    ``left`` marks the sets of which pairs are wanted (a pair needs one of them; default all).
    Two sets link if 100 * overlap >= percent * (n1 + n2 - overlap). ``visited`` collects the
    number of sets below each node that was entered.
    """
    size = len(n)
    if not size:
        return np.zeros(0, np.int64)
    wanted = np.ones(size, dtype=bool) if left is None else left
    flat = np.concatenate(tokens)
    of = np.repeat(np.arange(size), [len(t) for t in tokens])
    order = np.lexsort((of, flat))
    head = np.concatenate([[True], flat[order][1:] != flat[order][:-1]]) if len(flat) else np.zeros(0, bool)
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(head) - 1
    posting_at = np.append(np.flatnonzero(head), len(flat))
    posting = of[order]
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    path = [code[at[i] : at[i + 1]] for i in range(size)]
    length = np.diff(at)
    walk = np.array(sorted(range(size), key=lambda i: path[i].astype(">i8").tobytes()))
    shared = np.zeros(size + 1, np.int64)  # how far a path follows the one before it
    for k in range(1, size):
        a, b = path[walk[k - 1]], path[walk[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[k] = differ[0] if len(differ) else m
    component = np.arange(size)

    def extended(overlap: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not len(part):
            return overlap
        count = posting_at[part + 1] - posting_at[part]
        ends = np.cumsum(count)
        rows = posting[np.repeat(posting_at[part] - (ends - count), count) + np.arange(ends[-1])]
        return overlap + np.bincount(rows, minlength=size)

    # A node: the paths walk[lo:hi] with `top` tokens in common, and the overlaps of all sets with these tokens.
    nodes: list[tuple[int, int, int, np.ndarray]] = [(0, size, 0, np.zeros(size, np.int64))]
    while nodes:
        lo, hi, top, overlap = nodes.pop()
        below = walk[lo:hi]
        rest = int(length[below].max()) - top
        most = overlap + np.minimum(rest, length - overlap)
        open_ = (100 + percent) * most >= percent * (int(n[below].min()) + n)
        first = component[below[0]]
        if (component[below] == first).all():
            open_ &= component != first
        if not wanted[below].any():
            open_ &= wanted
        if not open_.any():
            continue
        if visited is not None:
            visited.append(hi - lo)
        if hi - lo > 1:
            depth = int(shared[lo + 1 : hi].min())
            overlap = extended(overlap, path[below[0]][top:depth])
            edges = np.concatenate([[lo], lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == depth), [hi]])
            nodes += [(int(a), int(b), depth, overlap) for a, b in zip(edges[:-1], edges[1:], strict=True)][::-1]
            continue
        i = int(below[0])
        whole = extended(overlap, path[i][top:])
        linked = (component != first) & ((100 + percent) * whole >= percent * (n[i] + n))
        if not wanted[i]:
            linked &= wanted
        if linked.any():
            linked[i] = True
            joined = np.unique(component[linked])
            component[np.isin(component, joined)] = joined[0]
    return component


def _join_group(table: pa.Table, percent: int) -> pa.Table:
    uid = table.column("uid").to_numpy()
    order = np.argsort(uid, kind="stable")
    order = order[np.concatenate([[True], uid[order][1:] != uid[order][:-1]])] if len(uid) else order
    tokens = [np.frombuffer(table.column("tokens")[int(i)].as_py(), np.uint64) for i in order]
    left = np.asarray(table.column("wanted").to_pylist(), dtype=bool)[order]
    root = trie_join(table.column("n").to_numpy()[order], tokens, percent, None if left.all() else left)
    own = uid[order]
    some = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(own[some], pa.int64()), "b": pa.array(own[root[some]], pa.int64())})


def links(representatives: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """Edges (a, b) between sets that links connect; enough of them for the components.

    Sets in blocks of ``part`` documents at most are joined in one task each. A larger block is
    dealt by hash into parts; every part is joined with itself and with the first. Sets that
    then stand outside the block's largest component are joined with all parts in turn.
    """
    rare = stage(rare_tokens(representatives, percent), "rare")
    hub = rare.groupBy("token").agg(F.min("uid").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    near = rare.join(checked_broadcast(stage(hub, "hubs")), "token").where("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b"))
    block = stage(components(near), "blocks")
    sizes = checked_broadcast(stage(block.groupBy("component").agg(F.count("*").alias("size")), "sizes"))
    placed = block.join(sizes, "component").withColumnRenamed("node", "uid")
    parts = F.ceil(F.col("size") / part).cast("int")
    dealt = placed.select("uid", F.col("component").alias("block"), parts.alias("parts"), F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"))
    members = stage(representatives.select("uid", "n", "tokens").join(dealt.hint("merge"), "uid"), "members")

    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block", "i", "j").applyInArrow(lambda t: _join_group(t, percent), "a long, b long")

    # Part 0 meets every part, so all tasks of a block hold it; a block of one part is one task.
    meets = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = members.select("block", F.lit(0).alias("i"), F.explode(meets).alias("j"), "uid", "n", "tokens", F.lit(True).alias("wanted"))
    found = stage(run(first), "links")
    if not members.where("parts > 1").limit(1).count():
        return found
    split = members.where("parts > 1").select("uid", "block", "parts", "part")
    now = split.join(components(found).withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    largest = now.groupBy("block", "component").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    outside = stage(now.join(checked_broadcast(stage(largest, "largest")), "block").where("component <> largest").select("uid", "block", "parts", "part"), "outside")
    if not outside.limit(1).count():
        return found
    lonely = stage(outside.groupBy("block").agg(F.count("*").alias("lonely")).withColumn("groups", F.ceil(F.col("lonely") / part).cast("int")).drop("lonely"), "lonely")
    lonely = checked_broadcast(lonely)
    group = F.pmod(F.xxhash64("uid", F.lit(5)), F.col("groups")).cast("int")
    body = members.select("uid", "n", "tokens", "block", "parts", "part")
    seekers = body.join(outside.select("uid"), "uid").join(lonely, "block").select("block", group.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "uid", "n", "tokens", F.lit(True).alias("wanted"))
    sought = body.join(lonely, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), F.col("part").alias("j"), "uid", "n", "tokens", F.lit(False).alias("wanted"))
    return found.union(stage(run(seekers.union(sought)), "links"))


@settled
def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per document: uid, doc_id, n_shingles, component_id, first_uid, and the ``keep`` columns as k0, k1 and so on.

    ``component_id`` is the smallest doc_id reachable by links of ``percent`` or more, the
    document's own included; ``first_uid`` is the row that has it (of several the one with the
    smallest uid). A null or empty text has no shingles and no links. Null doc_ids are ignored in
    a component's minimum, which is null where it has no others; repeated doc_ids are documents
    of their own. An empty table gives no rows; other columns are ignored.
    """
    all_sets = sets(docs, width, percent, doc_id, text, keep)
    more = [f"k{i}" for i in range(len(keep or []))]
    alive = all_sets.where("tokens is not null")
    same = stage(alive.groupBy("signature").agg(F.min("uid").alias("uid"), F.count("*").alias("k"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")), "classes")
    representatives = stage(alive.join(same.hint("merge"), ["signature", "uid"], "left_semi").select("uid", "signature", "n", "tokens"), "representatives")
    linked = components(links(representatives, percent)).withColumnRenamed("node", "uid")
    classes = same.join(linked, "uid", "left").where("k > 1 or component is not null").select("signature", "first", F.coalesce("component", "uid").alias("class"))
    classes = stage(classes, "shared-classes")
    least = checked_broadcast(stage(classes.groupBy("class").agg(F.min("first").alias("least")), "least"))
    # Sets of their own never meet the joins below; the rest find their class by a table that is sent to all tasks while it is small.
    grouped = checked_broadcast(stage(classes.join(least, "class").select("signature", "least"), "grouped"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    lone = all_sets.where("tokens is null").select("uid", "doc_id", "n", own.alias("least"), *more)
    found = alive.join(grouped, "signature", "left").select("uid", "doc_id", "n", F.coalesce("least", own).alias("least"), *more)
    return lone.unionByName(found).select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("first_uid"), *more)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of the rows of every component the one with the smallest doc_id, with all its columns.

    Rows are removed, not identifiers: other rows with a removed row's doc_id, or without one,
    stay if they stand for themselves. Of rows that share a component's smallest doc_id, and of
    a component's rows if none has a doc_id, one stays. Rows are told apart by their doc_id and
    128 bits of hashes of their text, so nothing but decisions is written; of rows that agree in
    both one is taken, if they stand for a component.
    """
    a, b = fresh("key_a", *docs.columns), fresh("key_b", *docs.columns)
    hashed = docs.withColumns({a: text_key("text")["a"], b: text_key("text")["b"]})
    with scratch(docs.sparkSession):
        found = jaccard_components(hashed, width, percent, keep=[a, b])
        alike = stage(found.groupBy("doc_id", "k0", "k1").agg(F.count("*").alias("k"), F.bool_or(F.col("uid") == F.col("first_uid")).alias("stays")), "alike")
        gone = finished(alike.where("not stays").select(F.col("doc_id").alias("d"), "k0", "k1"), "gone")
        twice = finished(alike.where("stays and k > 1").select(F.col("doc_id").alias("d"), "k0", "k1"), "twice")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(a) == F.col("k0")) & (F.col(b) == F.col("k1"))
    left = hashed.join(checked_broadcast(gone, SENT), same, "left_anti")
    if twice.limit(1).count():
        some = checked_broadcast(twice, SENT)
        left = left.join(some, same, "left_anti").union(left.join(some, same, "left_semi").dropDuplicates(["doc_id", a, b]))
    return left.select(*docs.columns)
