"""Change logs as streams: state by key, idempotent appends, flushes."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _one_machine() -> str:
    return tempfile.mkdtemp(prefix="chronokv-")


def work_dir(spark: SparkSession) -> str:
    """A new folder for checkpoints and results below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a session on one machine (tests) gets a folder of its own; on a cluster
    it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{_one_machine()}"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def fold(changes: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, order: str = "seq") -> None:
    """Applies a stream of changes once each: every trigger appends the keys that changed, with their newest version.

    The state store holds one row per key and the checkpoint is the log's applied position, so a
    restart goes on where it stopped. A batch that runs twice writes the same folder again.
    """
    keys = keys or ["key"]
    rest = [c for c in changes.columns if c not in keys]
    state = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def dedup(entries: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str | None = None, late: str = "1 hour") -> None:
    """Appends every entry once, however often the stream brings it.

    The state holds the keys that were seen. Without ``ts`` it holds all of them, which is right
    where the keys are a bounded domain; with it, repeats come at most ``late`` after the newest
    entry and older keys are forgotten.
    """
    once = entries.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if ts else entries.dropDuplicates(keys)
    query = once.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def flush_batches(changes: DataFrame, path: str, checkpoint: str, per_trigger_sorted_by: str = "key") -> None:
    """Every trigger becomes a sorted run of its own: (run_id, entries), folded per key."""
    from chronokv.operators.kv import latest

    def write(batch: DataFrame, n: int) -> None:
        latest(batch).withColumn("run_id", F.lit(n).cast("long")).sortWithinPartitions(per_trigger_sorted_by).write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling(events: DataFrame, width: str, late: str, path: str, checkpoint: str) -> None:
    """Counts and sums per event type and window; rows later than ``late`` behind the newest are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    query = windows.select(F.col("window.start").alias("start"), "event_type", "n", "total").writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
