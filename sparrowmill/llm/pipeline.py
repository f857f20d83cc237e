"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next stage's input.  All but the last return
the columns of documents.

Defined results: rows with null, empty or blank texts have under 50 words, so the rules reject them; a text
without known words isn't toxic; of rows that repeat a doc_id one stays after near-dedup, rows without one all stay
and are packed under a null id; nulls in other columns, and further columns of any name, pass all but the last stage
as they are; an empty table gives an empty result; without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import near_dedup, packing, pii, quality_rules, toxicity
from .common import delete, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the quality rules."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model fitted on the labelled ones of the input table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_dedup", distinct), ("pii", private), ("packing", packed)]

#: Training, signatures and packing can't be said in SQL; the stages are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's folder goes when the next one is written; the last one's input stays for its readers."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
