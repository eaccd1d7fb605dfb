"""Sorted runs: flush, merge, checks, catalogue, storage figures and Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronokv.functions.values import render
from chronokv.operators.kv import latest


def fold_runs(log: DataFrame) -> DataFrame:
    """One entry per key in every run: what a flush writes."""
    return latest(log, ["seq"], ["level", "run_id", "key"])


def flush(log: DataFrame, path: str, runs: str = "run_id") -> None:
    """Writes each run as sorted Parquet with a Bloom filter on the key, one folder a run."""
    out = fold_runs(log).repartition(runs).sortWithinPartitions(runs, "key")
    out.write.partitionBy(runs).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def flush_points(log: DataFrame, threshold: int, shard: str = "shard") -> DataFrame:
    """The log with the run that each record is flushed to: (.., run), from 0 within every shard.

    A shard's table is flushed when it holds ``threshold`` distinct keys. Each shard is read in
    its order by one task, which holds the keys of the open run only; the number of shards is the
    caller's.
    """
    ordered = log.repartition(shard).sortWithinPartitions(shard, "seq")

    def cut(batches):
        at, run, held = None, 0, set()
        for batch in batches:
            out = []
            for s, k in zip(batch[shard], batch["key"], strict=True):
                if s != at:
                    at, run, held = s, 0, set()
                held.add(k)
                out.append(run)
                if len(held) >= threshold:
                    run, held = run + 1, set()
            yield batch.assign(run=out)

    return ordered.mapInPandas(cut, StructType([*log.schema.fields, StructField("run", LongType())]))


def merge(runs: DataFrame) -> DataFrame:
    """The compaction of runs: of each key the entry of the lowest level, then of the newest run; tombstones stay."""
    return runs.groupBy("key").agg(F.min_by(F.struct(*[c for c in runs.columns if c != "key"]), F.struct("level", -F.col("run_id"))).alias("v")).select("key", "v.*")


def order_violations(entries: DataFrame) -> DataFrame:
    """Per run, how many neighbours in the stored order do not ascend."""
    w = Window.partitionBy("run_id").orderBy("seq")
    bad = F.lag("key").over(w) >= F.col("key")
    return entries.withColumn("bad", bad).groupBy("run_id").agg(F.count_if("bad").alias("violations"), F.count("*").alias("entries"))


def record_sizes(log: DataFrame) -> DataFrame:
    """Bytes of key and value and of the whole record, whose header has ten."""
    value = F.coalesce(F.octet_length(render()), F.lit(0))
    return log.withColumns({"key_len": F.octet_length("key"), "value_len": value}).withColumn("record_len", F.lit(10) + F.col("key_len") + F.col("value_len"))


def offsets(entries: DataFrame) -> DataFrame:
    """Where each record starts in its run's file, after the header of 45 bytes."""
    w = Window.partitionBy("run_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return record_sizes(entries).withColumn("offset", 45 + F.coalesce(F.sum("record_len").over(w), F.lit(0)))


def bloom_bits(n: Column, p: float = 0.01) -> Column:
    return F.greatest(F.lit(8), F.ceil(-n * math.log(p) / math.log(2) ** 2)).cast("long")


def bloom_hashes(n: Column, p: float = 0.01) -> Column:
    return F.greatest(F.lit(1), F.round(bloom_bits(n, p) / n * math.log(2))).cast("int")


def bloom_positions(key: str, bits: Column, hashes: Column) -> Column:
    """Double hashing by two 64-bit hashes of the key."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(F.pmod(h1, bits) + i * F.pmod(h2, bits), bits))


def bloom_probe(runs: DataFrame, probes: DataFrame, p: float = 0.01) -> DataFrame:
    """For every probed (run_id, key) whether the run's filter may hold the key: (run_id, key, may_contain).

    A filter is the set of its bit positions; a probe passes if all of its positions are set.
    """
    sized = runs.groupBy("run_id").agg(F.count_distinct("key").alias("n")).select("run_id", bloom_bits(F.col("n"), p).alias("bits"), bloom_hashes(F.col("n"), p).alias("hashes"))
    at = lambda d: d.select("run_id", "key").distinct().join(sized, "run_id").select("run_id", "key", F.explode(bloom_positions("key", F.col("bits"), F.col("hashes"))).alias("bit"))
    set_bits = at(runs).select("run_id", "bit").distinct().withColumn("on", F.lit(1))
    return at(probes).join(set_bits, ["run_id", "bit"], "left").groupBy("run_id", "key").agg((F.count("on") == F.count("*")).alias("may_contain"))


def valid_prefix(log: DataFrame, good: Column) -> DataFrame:
    """The records before the first bad one; one aggregate finds it, without a global window."""
    first_bad = log.where(~good).agg(F.min("seq").alias("first_bad"))
    return log.crossJoin(F.broadcast(first_bad)).where(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")
