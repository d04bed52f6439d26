"""The corpus pipeline: language ID, exact deduplication, near deduplication, decontamination and
packing. Each stage takes the rows that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, exact_dedup, langid, ngram_join, packing
from tidemill.llm.base import Scratch
from tidemill.llm.queries import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go; it learns from this stage's own input."""
    return langid.keep_identified(docs, langid.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the largest doc_id (a null one only where all are null). Rows are
    told apart by their places in the files, so ids may be null or repeat."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join stays, with the smallest doc_id (a null one only where
    all are null). Texts without words stay."""
    return ngram_join.keep_one_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language id", language), ("exact dedup", exact), ("n-gram join", near), ("decontamination", clean), ("packing", packed)]
#: SQL can express neither the learnt stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
