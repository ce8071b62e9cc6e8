"""A training corpus from ``documents``: language, boilerplate lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm.batches import prepare
from starloom.llm.decontaminate import decontaminate
from starloom.llm.language_id import keep_known_languages
from starloom.llm.line_dedup import dedup_lines
from starloom.llm.minhash import keep_one_of_each
from starloom.llm.packing import pack_documents
from starloom.llm.queries import fold_of, table
from starloom.plans.session import stage_table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    prepare(spark)
    return keep_known_languages(docs, fold_of(5, 0))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; those made of nothing else go."""
    return dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike to 0.8."""
    prepare(spark)
    return keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed sequences."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [("language_id", known_languages), ("line_dedup", without_boilerplate), ("near_dedup", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

#: SQL cannot express the learnt and tokenised stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
