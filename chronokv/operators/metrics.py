"""Request counters, histograms, quantiles and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronokv.operators.ordering import lagged, running

#: The metric library's default upper bounds in seconds (fixed values).
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def histogram(requests: DataFrame, by: list[str], value: str = "duration_s", bounds: list[float] | None = None) -> DataFrame:
    """Cumulative buckets in long form: (by.., le, cnt), the last of them infinite. One aggregate, then an unpivot."""
    bounds = bounds or BUCKETS
    each = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    rows = requests.groupBy(*by).agg(*each, F.count(value).alias("b_inf"))
    items = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("cnt")) for k, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("cnt"))]
    return rows.select(*by, F.explode(F.array(*items)).alias("x")).select(*by, "x.le", "x.cnt")


def merge_histograms(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Counts of equal bounds added over the series."""
    return buckets.groupBy(*by, "le").agg(F.sum("cnt").alias("cnt"))


def quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Linear interpolation in the first bucket that reaches q of the total; an infinite one gives the bound before it.

    The window runs over a series' bounds, of which there are a dozen.
    """
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("cnt").over(Window.partitionBy(*by))
    b = buckets.withColumns({"before": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("cnt").over(w), F.lit(0)), "total": total})
    first = b.where(F.col("cnt") >= q * F.col("total")).groupBy(*by).agg(F.min_by(F.struct("le", "cnt", "before", "below", "total"), "le").alias("x"))
    x = lambda c: F.col(f"x.{c}")
    inner = F.when(x("cnt") == x("below"), x("le")).otherwise(x("before") + (q * x("total") - x("below")) / (x("cnt") - x("below")) * (x("le") - x("before")))
    return first.select(*by, F.when(x("total") == 0, 0.0).when(x("le") == float("inf"), x("before")).otherwise(inner).alias("quantile"))


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact order statistics at the 0-based place min(floor(n * p), n - 1).

    Distinct values are counted first, so the window sorts counts of values, not rows.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    up_to = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = {k: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for k, p in shares.items()}
    return up_to.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > at[k], F.col(value))).alias(k) for k in shares], F.min(value).alias("min"), F.max(value).alias("max"))


def status_class(status: str) -> Column:
    c = F.col(status)
    return F.when(c.between(200, 299), "2xx").when(c.between(400, 499), "4xx").when(c.between(500, 599), "5xx").otherwise("other")


def parse_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Samples of the text format: (name, labels, value); comments, blank lines and values that are no number are left out."""
    pattern = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$'
    text = F.trim(column)
    pairs = F.regexp_extract_all("raw", F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 1), F.regexp_extract_all("raw", F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 2)
    rows = lines.where(~text.startswith("#") & text.rlike(pattern)).select(F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).alias("raw"), F.regexp_extract(text, pattern, 3).try_cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("name", F.map_from_arrays(*pairs).alias("labels"), "value")


def rate(samples: DataFrame, by: list[str], window_us: int) -> DataFrame:
    """Increase per second of a counter (us, cnt) over the ``window_us`` before each sample, resets counted as starts from 0.

    Samples of one time are taken in the order of their counts. Every step is added at its time and
    taken off after ``window_us``, so that one running sum has every window, however many samples
    there are in it; it runs over ranges, so that a long series is not sorted in one task.
    """
    known = lagged(samples, by, ["us", "cnt"], ["cnt"])
    before, us = F.col("before_cnt"), F.col("us")
    step = F.when(before.isNull(), 0).when(F.col("cnt") >= before, F.col("cnt") - before).otherwise(F.col("cnt"))
    rest = [c for c in samples.columns if c not in (*by, "us")]
    change = lambda at, off, x: F.struct(at.alias("at"), F.lit(off).alias("off"), x.alias("change"), *[(F.lit(None).cast(samples.schema[c].dataType) if off else F.col(c)).alias(c) for c in rest])
    both = F.array(change(us, False, step), change(us + window_us, True, -step))  # what is taken off at a time still counts then
    sums = running(known.select(*by, F.explode(both).alias("x")).select(*by, "x.*"), by, ["at", "off"], "change", "sum")
    return sums.where("not off").withColumnRenamed("at", "us").select(*samples.columns, (F.col("sum") / (window_us / 1e6)).alias("rate"))


def counters(increments: DataFrame, by: list[str], at: str) -> DataFrame:
    """Counters at the times they are read, from what was counted between: (by.., at, cnt). A series has a row for each reading."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return increments.select(*by, at, F.sum("cnt").over(w).alias("cnt"))


def last_increase(samples: DataFrame, now: DataFrame, by: list[str], at: str, window: int) -> DataFrame:
    """What each counter grew by over the last ``window`` readings' span before ``now``: (by.., increase).

    A reading lower than the one before it is a reset, from 0. The first reading of a series adds
    nothing, as what was before it is unknown.
    """
    w = Window.partitionBy(*by).orderBy(at)
    before = F.lag("cnt").over(w)
    grown = samples.withColumn("step", F.when(before.isNull(), 0).when(F.col("cnt") >= before, F.col("cnt") - before).otherwise(F.col("cnt")))
    return grown.crossJoin(F.broadcast(now)).groupBy(*by).agg(F.sum(F.when(F.col(at) > F.col("now") - window, F.col("step")).otherwise(0)).alias("increase"))
