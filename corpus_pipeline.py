"""From raw documents to a training mix: quality rules, line dedup, near-duplicate dedup, benchmark decontamination, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import decontaminate, linedup, mixing, neardup, quality
from linkweave.llm.common import DOCUMENT, load, session, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that are frequent on their host are cut out of the others."""
    return quality.clean(docs.select(*DOCUMENT))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out. A document goes only if all its words were such repeats, as an exact copy's are."""
    cut = linedup.deduplicated(docs.select(*DOCUMENT))
    left = F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed_words") == 0)
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs.select(*DOCUMENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs.select(*DOCUMENT), load(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources weigh the same."""
    return mixing.mix(docs.select(*DOCUMENT))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
# Latent retrieval and connected groups are beyond one SQL statement; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
