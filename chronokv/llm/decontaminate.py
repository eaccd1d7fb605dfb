"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

A window has as many words as a benchmark item (or is the whole document, if that is shorter).
Fingerprints are compared through a multi-index: 64 bits in ``radius`` + 1 blocks, and two that
differ in ``radius`` bits or fewer agree in a block at least. Candidates are then verified by
the exact weighted similarity of their shingles, each weighted by how often it occurs: the sum
of the smaller weights over the sum of the larger ones.

Which windows get a fingerprint is decided exactly. A similar window holds all but a fifth of
its item's shingles, so it holds one of any more than that: the item's rarest among the items.
Documents are searched for these only. In a document that has one, the places of all of that
item's shingles are counted; a running count over them bounds what the window at each start can
share, and every window that can reach the threshold, at whatever start, is fingerprinted. The
multi-index then compares it with that item, so its work grows with the windows found and not
with their product with the benchmark. Texts that are equal are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronokv.llm.common import checked_broadcast, finished, scratch, settled, stage, text_key

#: At a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average, with a deviation
#: of 2.9; 23 bits are 4.6 deviations above.
RADIUS = 23
SENT = 500_000  # narrow rows (of a benchmark, keys of texts) up to which they are sent to all tasks that read documents


def words(text: str | Column) -> Column:
    """Lower-case words between white space; none for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(column.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def fingerprint(bits_of: str) -> Column:
    """An aggregate: the SimHash of a group's shingle hashes, each row counting once."""
    h, out = F.col(bits_of), F.lit(0).cast("long")
    for b in range(64):
        ahead = F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")) * 2 - 1) > 0
        out = out.bitwiseOR(F.when(ahead, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def blocks(of: str, radius: int) -> Column:
    """(number, value) of the ``radius`` + 1 blocks of a fingerprint."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(of, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def tagged_shingles(words_column: str, widths: list[int]) -> Column:
    """(width, p, h) of all shingles of the given widths, in one array."""
    w = F.col(words_column)

    def of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.lit(k).alias("width"), i.alias("p"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h")))
        return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<struct<width:int,p:int,h:bigint>>"))

    return F.concat(*[of(k) for k in widths])


def rarest(counts: DataFrame, percent: int) -> DataFrame:
    """(width, h, item): of every item so many of its rarest shingles that a similar window has one of them.

    ``counts``: (item, width, total, h, e), e the shingle's count in the item. A window that
    reaches the threshold shares ``percent`` of the item's shingles or more, repeats counted.
    """
    among = counts.groupBy("width", "h").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "h")
    spare = F.col("total") - F.ceil(F.lit(percent) * F.col("total") / 100)
    ranked = counts.join(among, ["width", "h"]).withColumn("before", F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("e"))
    return ranked.where(F.col("before") <= spare).select("width", "h", "item")


def reachable(places: DataFrame, percent: int) -> DataFrame:
    """(text_key, item, n, width, at): every start whose window can be similar to the item of ``n`` words.

    ``places``: (text_key, item, size, n, width, p), once each, where a text has a shingle of the
    item. A place counts for the starts of the windows around it; the count is at least what the
    window shares with the item. It changes at the first start of a place and after its last, so
    it is summed over these and not over starts.
    """
    span = F.least("n", "size") - F.col("width")
    first, last = F.greatest(F.lit(0), F.col("p") - span), F.least(F.col("p"), F.greatest(F.lit(0), F.col("size") - F.col("n")))
    changes = places.select("*", F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("by")), F.struct((last + 1).alias("at"), F.lit(-1).alias("by")))).alias("c"))
    pair = ["text_key", "item", "size", "n", "width"]
    window = Window.partitionBy(*pair).orderBy("at")
    summed = changes.groupBy(*pair, F.col("c.at").alias("at")).agg(F.sum("c.by").alias("by"))
    counted = summed.select("*", F.sum("by").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("most"), F.lead("at").over(window).alias("next"))
    total = F.col("n") - F.col("width") + 1 + span + 1
    enough = counted.where((F.col("most") > 0) & ((100 + percent) * F.col("most") >= percent * total))
    return enough.select("text_key", "item", "n", "width", F.explode(F.sequence("at", F.col("next") - 1)).alias("at"))


def similar_texts(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, radius: int = RADIUS, text: str = "text", item_id: str = "item_id", prints: list | None = None) -> DataFrame:
    """(text_key, item_id, similarity): each distinct text and each item that it holds a similar window of.

    ``prints`` collects the written tables of fingerprints and of candidates, for measurements.
    """
    kind = benchmark.schema[item_id].dataType
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), words(text).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = stage(items.withColumn("width", F.least(F.lit(width), F.col("n"))), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # ``width`` values at most
    if not widths:
        return docs.select(text_key(text).alias("text_key"), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity")).where("false")
    item_shingles = stage(items.select("item", "item_id", "n", F.explode(F.filter(tagged_shingles("w", widths), lambda s: s["width"] == F.col("width"))).alias("s")).select("item", "item_id", "n", "s.width", "s.h"), "item-shingles")
    counts = stage(item_shingles.groupBy("item", "n", "width", "h").agg(F.count("*").alias("e")).withColumn("total", F.col("n") - F.col("width") + 1), "item-counts")
    known = checked_broadcast(stage(rarest(counts, percent), "rarest"), SENT)

    rows = docs.select(text_key(text).alias("text_key"), words(text).alias("w"))
    found = rows.select("text_key", F.explode(tagged_shingles("w", widths)).alias("s")).select("text_key", "s.width", "s.h").join(known, ["width", "h"])
    pairs = stage(found.select("text_key", "item").distinct(), "pairs")
    # Only texts with such pairs are read again, each once.
    wanted = checked_broadcast(stage(pairs.select("text_key").distinct(), "texts"), SENT)
    again = stage(rows.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"]), "again")
    told = pairs.join(checked_broadcast(counts, SENT), "item").select("text_key", "item", "n", "width", "h")
    each = again.select("text_key", F.size("w").alias("size"), F.explode(tagged_shingles("w", widths)).alias("s")).select("text_key", "size", "s.*")
    places = each.join(told, ["text_key", "width", "h"]).select("text_key", "item", "size", "n", "width", "p")
    windows = stage(reachable(places, percent), "windows")
    window = ["text_key", "item", "at"]

    placed = windows.join(again, "text_key").select(*window, "width", F.slice("w", F.col("at") + 1, F.col("n")).alias("w"))
    inside = stage(placed.select(*window, F.explode(F.filter(tagged_shingles("w", widths), lambda s: s["width"] == F.col("width"))).alias("s")).select(*window, "s.h"), "window-shingles")
    print_of = stage(inside.groupBy(*window).agg(fingerprint("h").alias("f"), F.count("*").alias("total")), "window-prints")
    item_print = stage(item_shingles.groupBy("item", "item_id").agg(fingerprint("h").alias("g"), F.count("*").alias("item_total")), "item-prints")
    left = print_of.select(*window, "f", "total", F.explode(blocks("f", radius)).alias("b")).select("*", "b.*").drop("b")
    right = item_print.select("item", "item_id", "g", "item_total", F.explode(blocks("g", radius)).alias("b")).select("*", "b.*").drop("b")
    near = left.join(checked_broadcast(right, SENT), ["item", "block", "value"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    candidates = near.select(*window, "total", "item_id", "item_total").distinct()
    if prints is not None:
        prints += [print_of, stage(candidates, "candidates")]

    own = inside.groupBy(*window, "h").agg(F.count("*").alias("c"))
    shared = candidates.join(own, window).join(checked_broadcast(counts.select("item", "h", "e"), SENT), ["item", "h"]).groupBy(*window, "item_id", "total", "item_total").agg(F.sum(F.least("c", "e")).alias("o"))
    union = F.col("total") + F.col("item_total") - F.col("o")
    return stage(shared.where(100 * F.col("o") >= percent * union).groupBy("text_key", "item_id").agg(F.round(F.max(F.col("o") / union), 6).alias("similarity")), "similar")


@settled
def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, similarity): every item that a document holds a window of, with the best similarity.

    Items of fewer than ``width`` words are compared by a single shingle of all of them; empty
    items match nothing. Items with one item_id are judged apart and reported once. A null text is
    an empty one. Rows with one doc_id are judged apart and reported once; a null doc_id is
    reported as null. Other columns are ignored. Texts are told apart by 128 bits of hashes.
    """
    similar = similar_texts(docs, benchmark, width, percent, radius, text, item_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"))
    return rows.join(checked_broadcast(similar, SENT), "text_key").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose text holds no window similar to an item, with all their columns.

    Rows are removed and not identifiers: a clean row stays whatever other rows its doc_id has,
    and so does one without a doc_id. Only the found texts' keys are written.
    """
    with scratch(docs.sparkSession):
        found = finished(similar_texts(docs, benchmark, width, percent).select("text_key").distinct(), "found")
    return docs.join(checked_broadcast(found, SENT), text_key("text") == found["text_key"], "left_anti")


#: Every window against every item that shares a shingle with it.
CONTAMINATED_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS width FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, n, width, k, array_to_string(w[k + 1 : k + width], ' ') AS s FROM bi, LATERAL (SELECT unnest(range(n - width + 1)) AS k)),
bc AS (SELECT item_id, n, width, s, count(*) AS e FROM bs GROUP BY ALL),
ws AS (SELECT DISTINCT width FROM bi),
ds AS (SELECT doc_id, len(w) AS size, width, p, array_to_string(w[p + 1 : p + width], ' ') AS s
  FROM d, ws, LATERAL (SELECT unnest(range(len(w) - width + 1)) AS p) WHERE len(w) >= width),
hit AS (SELECT doc_id, size, item_id, n, width, p, s, e FROM ds JOIN bc USING (width, s)),
win AS (SELECT DISTINCT doc_id, item_id, n, width, size, beg FROM hit,
  LATERAL (SELECT unnest(range(greatest(0, least(p - n + width, size - n)), greatest(0, least(p, size - n)) + 1)) AS beg)),
o AS (SELECT win.doc_id, win.item_id, win.beg, win.n, win.width, win.size, h.s, least(count(*), any_value(h.e)) AS c
  FROM win JOIN hit h ON h.doc_id = win.doc_id AND h.item_id = win.item_id AND h.p >= win.beg AND h.p <= win.beg + least(win.n, win.size) - win.width GROUP BY ALL),
t AS (SELECT doc_id, item_id, beg, sum(c) AS o, (any_value(n) - any_value(width) + 1) + (least(any_value(n), any_value(size)) - any_value(width) + 1) AS total FROM o GROUP BY ALL)
SELECT doc_id, item_id, round(max(o / (total - o)), 6) AS similarity FROM t WHERE 100 * o >= 80 * (total - o) GROUP BY ALL
"""
