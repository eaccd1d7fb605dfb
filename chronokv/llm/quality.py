"""Quality: a sparse rule ensemble.

Small random trees over document statistics give conjunctive rules, one for every path from a
root; a logistic regression with a lasso penalty over the rules' truth values keeps few of them;
the rules kept, with their weights, are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronokv.llm.common import settled, stage
from chronokv.llm.textstats import NAMES, held_out, labelled_sample, with_statistics


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most?, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for k, most, t in self.parts:
            x = F.col(stats)[k]
            out = out & ((x <= t) if most else (x > t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{NAMES[k]} {'<=' if most else '>'} {t:.6g}" for k, most, t in self.parts)


def _shortened(parts: list[tuple[int, bool, float]]) -> Rule:
    """One bound for each statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for k, most, t in parts:
        tight[k, most] = t if (k, most) not in tight else min(t, tight[k, most]) if most else max(t, tight[k, most])
    return Rule(tuple(sorted((k, most, t) for (k, most), t in tight.items())))


def paths(tree) -> list[Rule]:
    """The rules of every node below a tree's root, from Spark's node objects."""
    out: list[Rule] = []

    def walk(node, parts):
        if parts:
            out.append(_shortened(parts))
        if node.numDescendants():
            split = node.split()
            k, t = split.featureIndex(), split.threshold()
            walk(node.leftChild(), [*parts, (k, True, t)])
            walk(node.rightChild(), [*parts, (k, False, t)])

    walk(tree._call_java("rootNode"), [])
    return out


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: str = "stats") -> Column:
        """The probability of class 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, trees: int = 24, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """Fits on at most about ``most`` labelled rows of each class, none of the held-out fifth.

    Every path of the forest is a rule (at most ``trees`` times 2^(``depth`` + 1) - 2 of them) and
    all go to the lasso. Without rows of both classes there are no rules and the score is near the class that there is (0.5 without labels).
    """
    import math

    sample = stage(labelled_sample(docs, labels, label, most), "sample")
    stats = stage(with_statistics(sample, None, ["label", "weight", "fold"]).withColumn("label", F.col("label").cast("double")), "stats").coalesce(2)
    total = {r["label"]: r["w"] for r in stats.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if len(total) < 2:
        good, bad = total.get(1.0, 0.0) + 0.5, total.get(0.0, 0.0) + 0.5
        return RuleEnsemble(math.log(good / bad), [])
    grown = stats.withColumn("features", array_to_vector("stats"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.4", subsamplingRate=0.7, minInstancesPerNode=8, seed=3).fit(grown)
    rules = sorted(dict.fromkeys(r for t in forest.trees for r in paths(t)), key=lambda r: (len(r.parts), r.parts))
    truth = stats.select("label", "weight", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("truth"))
    model = LogisticRegression(featuresCol="truth", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(truth)
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


@settled
def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Only the text is scored.

    Null and repeated doc_ids are kept; a null text is an empty one; an empty table gives no rows.
    """
    ensemble = fit(docs, labels)
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", ensemble.score())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
