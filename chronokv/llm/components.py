"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import stage

BROADCAST_EDGES = 50_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node
    seen; the edges are staged after each round and the rounds end when nothing changes. All
    steps are minima and equi-joins, so no node's neighbours are ever collected.
    """
    state = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = (state.count(), None)
    for _ in range(rounds):
        # A table with a row for each node: sent to all tasks while it is small, so that a node with very many edges is no hot key.
        small = F.broadcast if before[0] <= BROADCAST_EDGES else lambda x: x
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        state = stage(star, "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    nodes = state.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
