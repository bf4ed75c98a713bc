"""A training corpus from `documents`: five stages, each an operator of auditlake.llm.

Every stage gets all rows that the one before has kept, read back from Parquet in the shared folder, so a
lost executor never costs more than one stage. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from auditlake.llm._tables import Scratch, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on this stage's input, scores at 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of two benchmark items or more, and without the passages of one."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express the classifier and the classes of near duplicates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark, "pipeline")
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        if kept is not None:
            scratch.drop(kept)
        docs = kept = after
    return docs
