"""Corpus pipeline: language ID, near-dedup, substring dedup, benchmark
decontamination, mixing.

``run`` applies the stages to ``documents``; each result is written as Parquet
in the shared folder and read again as the next stage's input.  What a stage
stores on the way, and the result it read, are removed once its own is written.
Texts pass to Python in small Arrow batches (``common.small_batches``; settings
of the session other than Spark's defaults stay).

Defined results: a null or empty text has no language and goes in the first
stage (unless no row has a label: then the stage passes all); an empty table gives an empty result; columns beside those of
``documents`` pass through (in the last stage ``size``, ``source_size``,
``target``, ``taken``, ``epoch`` and ``words`` are replaced).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from marktwert.llm import common, decontaminate, language_id, mixing, near_dedup, substring_dedup
from marktwert.session import remove_path, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; the model learns from the
    stage's own input."""
    common.small_batches(spark)
    return language_id.keep_identified(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group of near duplicates stays."""
    common.small_batches(spark)
    return near_dedup.keep_one_per_group(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines, paragraphs, sentence chains and chunks are cut from all
    but their first place."""
    common.small_batches(spark)
    return substring_dedup.without_repeats(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    common.small_batches(spark)
    return decontaminate.drop_contaminated(spark, docs, common.documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of each document that the mix takes."""
    return mixing.mixed_copies(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Mixture inference and the dedup stages are iterative: no SQL form; tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        written = shared_path(spark, "pipeline", f"{name}-{uuid4().hex}")
        with common.scratch(spark, name):
            docs = common.store_at(spark, stage(spark, docs, sf_dir), written)
        if read:
            remove_path(spark, read)
        read = written
    return docs
