"""The corpus pipeline: five stages from raw documents to a training mix.

Every stage works on what the stage before has written, and calls one of the
operators of snagline.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snagline.llm import decontaminate, exact_dedup, langid, mixing, neardup
from snagline.llm.common import read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, for which no language is predicted."""
    return langid.drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, source_size, target and taken; documents that the mix does not take go."""
    return mixing.drop_untaken(docs)


#: In the order in which they run.
STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", benchmarks),
    ("mixing to target weights", mixture),
]

#: SQL can't express language ID, near duplicates and random rounding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over what the one before has written.

    Null and empty texts, and those without letters, go in the first stage; ties
    and repeated rows are settled as the operators say; columns of documents may
    have any name, but size, source_size, target and taken give way to those of
    the mix.  An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
