"""Documents to training shards: stages written and read again one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import stages
from veilframe.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Keep what passes the quality rules; one document of each group of near
#: duplicates; no document with benchmark passages; sources by weight; shards.
STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

#: Fingerprints by XXH64 and seeded permutations are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
