"""Versioned key-value state: folds, lookups and overlays of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["is_deleted", "type", "int_value", "float_value", "string_value"]


def latest(log: DataFrame, order: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The newest version of every key, tombstones included.

    One hash aggregate with a partial step per task, so a key with very many versions is folded
    before the shuffle; no window and no sort.
    """
    keys, order = keys or ["key"], order or ["seq"]
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*keys).agg(best.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def live(state: DataFrame) -> DataFrame:
    """Without tombstones; only right after the fold, as a tombstone hides older versions."""
    return state.where(~F.col("is_deleted")).drop("is_deleted")


def snapshot(log: DataFrame) -> DataFrame:
    return live(latest(log))


def as_of(log: DataFrame, seq: int | Column) -> DataFrame:
    """The snapshot after all records up to ``seq``."""
    return snapshot(log.where(F.col("seq") <= seq))


def get(log: DataFrame, key: str) -> DataFrame:
    """One key: the filter goes to the scan before the fold."""
    return snapshot(log.where(F.col("key") == key))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per wanted key, with nulls where it is missing or deleted; the log is cut down to the keys first."""
    state = snapshot(log.join(wanted.select("key").distinct(), "key", "left_semi"))
    return wanted.join(state, "key", "left")


def history(log: DataFrame) -> DataFrame:
    """Every version with its number, the seq at which it ends (null: current) and the type before it."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.withColumns({"version": F.row_number().over(w), "until": F.lead("seq").over(w), "type_before": F.lag("type").over(w)})


def overlay(top: DataFrame, below: DataFrame) -> DataFrame:
    """Two states: a key of ``top`` hides that of ``below``, a tombstone too."""
    both = top.withColumn("layer", F.lit(1)).unionByName(below.withColumn("layer", F.lit(0)))
    return latest(both, ["layer"]).drop("layer")
