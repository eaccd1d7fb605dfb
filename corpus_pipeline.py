"""The corpus pipeline: stages over documents, each by an operator of ``chronokv.llm``.

Counted as part of that subpackage. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronokv.llm import decontaminate, jaccard, packing, substrings, toxicity
from chronokv.llm.common import finished, scratch, stage, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is fitted on the labelled rows of these documents."""
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of 0.8 or more over five-word shingles connect, one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out of the later ones."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window similar to a benchmark item go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack(docs).select("doc_id", "start", "length", "doc_tokens", "sequence_id", F.col("offset"), "ids_crc32")


STAGES = [
    ("toxicity", toxic),
    ("jaccard", near_duplicates),
    ("substrings", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("packing", packed),
]

#: The classifier and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each is written and read again.

    What the stages wrote is deleted when the last one's result is there.
    """
    with scratch(spark):
        docs = table(spark, sf_dir, "documents")
        for name, f in STAGES[:-1]:
            docs = stage(f(spark, docs, sf_dir), name)
        return finished(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
