"""Deterministic event streams: order, faults on links and nodes, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_next(events: DataFrame, faults: DataFrame) -> DataFrame:
    """Without the next ``n`` messages of every link in ``faults`` (src, dst, n)."""
    w = Window.partitionBy("src", "dst").orderBy("sequence")
    return events.join(F.broadcast(faults), ["src", "dst"], "left").withColumn("k", F.row_number().over(w)).where(F.col("n").isNull() | (F.col("k") > F.col("n"))).select(*events.columns)


def delay(events: DataFrame, faults: DataFrame) -> DataFrame:
    """Delivery later by ``delay_us`` on the links in ``faults``."""
    return events.join(F.broadcast(faults), ["src", "dst"], "left").withColumn("us", F.col("us") + F.coalesce("delay_us", F.lit(0))).select(*events.columns)


def duplicate_next(events: DataFrame, faults: DataFrame, after_us: int) -> DataFrame:
    """The next ``n`` messages of the links in ``faults`` twice, the copy ``after_us`` later: (.., copy)."""
    w = Window.partitionBy("src", "dst").orderBy("sequence")
    ranked = events.join(F.broadcast(faults), ["src", "dst"], "left").withColumn("k", F.row_number().over(w))
    copies = F.when(F.col("k") <= F.col("n"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return ranked.withColumn("copy", F.explode(copies)).withColumn("us", F.col("us") + F.col("copy") * after_us).select(*events.columns, "copy")


def pause(events: DataFrame, pauses: DataFrame) -> DataFrame:
    """Messages to a node that is paused at their time arrive when it resumes: ``pauses`` (dst, from_us, to_us), apart in time."""
    paused = pauses.withColumnRenamed("dst", "node")
    hit = (F.col("dst") == F.col("node")) & (F.col("us") >= F.col("from_us")) & (F.col("us") < F.col("to_us"))
    return events.join(F.broadcast(paused), hit, "left").select("sequence", "src", "dst", F.greatest("us", F.coalesce("to_us", "us")).alias("us"))


def deliverable(events: DataFrame, disabled: DataFrame, blocked: DataFrame) -> DataFrame:
    """Without messages of disabled nodes (node) and on blocked links (src, dst)."""
    out = events.join(F.broadcast(disabled.select(F.col("node").alias("src"))), "src", "left_anti").join(F.broadcast(disabled.select(F.col("node").alias("dst"))), "dst", "left_anti")
    return out.join(F.broadcast(blocked), ["src", "dst"], "left_anti").select(*events.columns)


def partition_links(nodes: DataFrame, side: str) -> DataFrame:
    """Both directions of every link between the nodes where ``side`` holds and the others: a product of two node lists."""
    a, b = nodes.where(side).select(F.col("node").alias("src")), nodes.where(f"not ({side})").select(F.col("node").alias("dst"))
    links = a.crossJoin(b)
    return links.union(links.select("dst", "src"))


def fault_of(roll: str, faults: list[tuple[str, float]]):
    """The first fault whose cumulative probability exceeds the roll, or null."""
    total, bounds = 0.0, []
    for name, p in faults:
        total += p
        bounds.append((name, total))
    out = F.lit(None).cast("string")
    for name, bound in reversed(bounds):
        out = F.when(F.col(roll) < bound, name).otherwise(out)
    return out
