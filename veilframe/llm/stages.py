"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the docs that go on.

Every stage takes documents under any further columns and, but for the last, returns
the columns it got.  Nulls, empty texts, repeated rows and empty tables are treated as
the operators' docstrings say: a null or empty text goes at the first stage, for it has
too few words.  Very long texts are judged whole.  Of linked documents with equal ids one
stays; other ties do not decide which rows go on.  Further columns may have any name: the
operators pin their input under names of their own, and ``sharding`` alone replaces columns,
those named ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import contamination, mixing as mixes, quality as rules, sharding as shards, simhash
from veilframe.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one of smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; a copy is a row."""
    return mixes.mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return shards.shard(docs)
