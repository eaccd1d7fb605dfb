"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned too: words, and stems of 5 to 8 letters, whose share of toxic rows'
texts is far above that of the others'. It, the trees and the calibration are each fitted on
rows of their own, so none flatters the next.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import binary_view, gathered, scratch, settled, stage, text_bytes, tidy
from chronokv.llm.textstats import held_out, labelled_sample, letter_words, terms, with_statistics


def learn_lexicon(sample: DataFrame, support: int = 5, ratio: float = 15.0) -> dict[str, float]:
    """Terms with ``support`` toxic texts at least and a share ``ratio`` times the clean texts'.

    As many as the sample has, which is of bounded size; all of them go to the driver.
    """

    def run(batches):
        from collections import Counter

        for batch in gathered(batches, "data"):
            code, kinds, row, _ = letter_words(*binary_view(batch.column("data")))
            label = np.asarray(batch.column("label").to_pylist(), dtype=np.int64)
            of = [terms(w.decode("utf-8", "replace").lower()) for w in kinds]
            counts = (Counter(), Counter())
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                counts[label[i]].update({t for k in set(code[edges[i] : edges[i + 1]].tolist()) for t in of[k]})
            names = list(counts[1])  # a term of no toxic text here may be one of another batch
            names += [t for t in counts[0] if t not in counts[1]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["term", "toxic", "clean"])

    totals = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals["toxic"] or 0, (totals["n"] or 0) - (totals["toxic"] or 0)
    if not toxic or not clean:
        return {}
    counted = sample.select("label", text_bytes("text").alias("data")).mapInArrow(tidy(run), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    rows = counted.where((F.col("toxic") >= support) & (odds >= ratio)).select("term", odds.alias("odds")).collect()
    return {r["term"]: math.log(r["odds"]) for r in rows}


class Model:
    """The lexicon, the trees and the calibration."""

    def __init__(self, weights, trees, calibration, prior: float):
        self.weights, self.trees, self.calibration, self.prior = weights, trees, calibration, prior

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """``keep`` and ``score``; every row has one, an empty or null text too."""
        rows = with_statistics(docs, self.weights, keep, text)
        if self.trees is None:
            return rows.select(*keep, F.lit(self.prior).alias("score"))
        raw = vector_to_array(F.col("probability"))[1]
        out = self.trees.transform(rows.withColumn("features", array_to_vector("stats"))).select(*keep, raw.alias("raw"))
        # The steps of the calibration keep the order of the trees' scores within them.
        return self.calibration.transform(out).select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, iterations: int = 20, depth: int = 4) -> Model:
    """Fits on at most about ``most`` labelled rows of each class, none of the held-out fifth.

    Folds 0-4 give the lexicon, 5-7 the trees, 8-9 the calibration. Without rows of both classes
    the score is the share of the class that there is (0 without labels).
    """
    sample = stage(labelled_sample(docs, labels, label, most), "sample")
    share = sample.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    total = {r["label"]: r["w"] for r in share}
    prior = float(total.get(1, 0.0) / max(1e-9, sum(total.values())))
    weights = learn_lexicon(sample.where("fold < 5"))
    rest = sample.where("fold >= 5")
    stats = stage(with_statistics(rest, weights, ["label", "weight", "fold"]).withColumn("features", array_to_vector("stats")).withColumn("label", F.col("label").cast("double")).drop("stats"), "stats").coalesce(2)
    train = stats.where("fold < 8")
    if train.select("label").distinct().count() < 2:
        return Model(weights, None, None, prior)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.3, maxBins=64, minInstancesPerNode=5, seed=1).fit(train)
    check = trees.transform(stats.where("fold >= 8")).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    if not check.limit(1).count():
        check = trees.transform(train).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(check)
    return Model(weights, trees, calibration, prior)


@settled
def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Only the text is scored.

    Null and repeated doc_ids are kept; a null text is an empty one; an empty table gives no rows.
    """
    model = fit(docs, labels)
    return model.score(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns; nothing is written but while fitting."""
    with scratch(docs.sparkSession):
        model = fit(docs, labels)
    scored = model.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), ["row"])
    return scored.where(F.col("score") < threshold).select("row.*")
