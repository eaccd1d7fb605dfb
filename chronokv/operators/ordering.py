"""Numbers, predecessors and running sums within a few keys that hold very many rows.

A window over such a key sorts it in one task. Here the rows are dealt by ranges of (keys, order),
each range is sorted on its own, and what a range must know of those before it (a count, the last
row) is one row for each range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokv.streaming.state import work_dir


def _name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def ranges(df: DataFrame, keys: list[str], order: list[str], part: str) -> DataFrame:
    """The rows dealt by ranges, with the number of their range; written, so that it is fixed."""
    spark: SparkSession = df.sparkSession
    path = f"{work_dir(spark)}/ranges"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """Numbers the rows of every key from 1 in the given order, which must be total."""
    part, earlier = _name(df, "part"), _name(df, "earlier")
    dealt = ranges(df, keys, order, part)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias("n")).select(*keys, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(earlier))
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return dealt.withColumn(number, own).join(counts, [*keys, part]).withColumn(number, F.col(number) + F.col(earlier)).select(*df.columns, number)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, total: str) -> DataFrame:
    """The sum of a column up to each row and its equals in the order, within the key."""
    part, earlier = _name(df, "part"), _name(df, "earlier")
    dealt = ranges(df, keys, order, part)  # equals are in one range
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, part).agg(F.sum(value).alias("n")).select(*keys, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(earlier))
    own = F.sum(value).over(Window.partitionBy(*keys, part).orderBy(*order))
    return dealt.withColumn(total, own).join(sums, [*keys, part]).withColumn(total, F.col(total) + F.col(earlier)).select(*df.columns, total)


def lagged(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``before_<column>``: the values of the row before, within the key; null for the first."""
    part, edge = _name(df, "part"), _name(df, "edge")
    dealt = ranges(df, keys, order, part)
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    row = F.struct(*columns)
    # The last row of each range goes to the next range that has the key.
    ends = dealt.groupBy(*keys, part).agg(F.max_by(row, F.struct(*order)).alias(edge)).withColumn(edge, F.lag(edge).over(Window.partitionBy(*keys).orderBy(part)))
    first = F.row_number().over(inner) == 1
    with_own = dealt.withColumns({"own": F.lag(row).over(inner), "first": first})
    both = with_own.join(ends, [*keys, part])
    chosen = F.when(F.col("first"), F.col(edge)).otherwise(F.col("own"))
    return both.select(*df.columns, *[chosen[c].alias(f"before_{c}") for c in columns])
