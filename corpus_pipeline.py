"""Corpus pipeline: stages over the documents table, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmerge.llm.common import own_id, shown_id, stage, table
from leadmerge.llm.decontamination import contaminated
from leadmerge.llm.jaccard import jaccard_groups
from leadmerge.llm.mixing import mix_sources
from leadmerge.llm.substrings import substring_dedup
from leadmerge.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not call toxic; the model is learnt from them and ``labels``."""
    named = _named(docs)
    return _without(docs, toxicity(named, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id, or the first text by hash if none has one."""
    groups = jaccard_groups(_named(docs).select(F.col("doc_id").alias("id"), "text"))
    return _without(docs, groups.filter("id <> component_id").withColumnRenamed("id", "doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; emptied documents go."""
    cut = substring_dedup(docs)
    # A text that was empty before is not this stage's to judge.
    kept = cut.filter("n_removed = 0 or n_removed < n_sentences")
    return kept.withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    ).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, up to edits."""
    return _without(docs, contaminated(_named(docs), table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with a number made from the text where there is no id, so that every row can be named."""
    return docs.withColumn("doc_id", own_id(F.col("doc_id"), F.col("text")))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` that ``bad`` does not name by the ids of :func:`_named`.

    Rows that repeat an id, or without ids a text, are named together and go together.
    Null and empty texts and empty tables pass; other columns are carried as they are.
    """
    left = _named(docs).join(bad.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("doc_id", shown_id(F.col("doc_id")))
    return left.select(docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_per_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]
# Models, hashes and random numbers: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to the documents; every stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
