"""Encoding of document streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import entities as E
from veilframe.operators.encode import encode, encode_corpus
from veilframe.session import own_scratch
from veilframe.sources.store import MappingStore


def encode_stream(docs: DataFrame, strategy: str = "redact", **options: Any) -> DataFrame:
    """Stateless strategies on a streaming DataFrame: the batch expressions as
    they are, since each row is encoded on its own."""
    if strategy == "replace":
        raise ValueError("placeholders need the growing mapping: use encode_batches")
    return encode(docs, strategy=strategy, **options).drop("mapping", "spans")


# A batch whose number is a multiple of this writes its whole state, others what changed.
SNAPSHOT = 16


def read_state(spark: SparkSession, state_path: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Mapping and surface forms after a batch: the last whole state up to it, and what
    changed since."""
    versions = range(batch_id - batch_id % SNAPSHOT, batch_id + 1)

    def versioned(kind: str) -> DataFrame:
        paths = [f"{state_path}/{kind}/version={v}" for v in versions]
        return spark.read.option("basePath", f"{state_path}/{kind}").parquet(*paths)

    row = F.struct("version", *E.MAPPING_COLUMNS)
    latest = versioned("mapping").groupBy("placeholder").agg(F.max_by(row, "version").alias("row"))
    mapping = latest.select("row.*").select(*E.MAPPING_COLUMNS)
    forms = versioned("forms").groupBy("placeholder", "norm_key", "value")
    return mapping, forms.agg(F.sum("occurrences").alias("occurrences"))


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Delete the versions of a table below a number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.split("=")[1]) < before:
            files.delete(status.getPath(), True)


def encode_batches(
    spark: SparkSession,
    state_path: str,
    output_path: str,
    mapping: DataFrame | None = None,
    forms: DataFrame | None = None,
    **options: Any,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that replaces by one mapping which grows, from the
    given ``mapping`` and ``forms`` on if there are any.

    A micro-batch writes the entries it added or changed and the forms it saw under its
    own number; every sixteenth writes the whole state, and versions before the whole
    state that precedes it are deleted.  A batch that is run again reads what it read
    before and overwrites its own output with the same content.  Its scratch tables are
    deleted with it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with own_scratch(batch.sparkSession):
            encode_batch(batch, batch_id)

    def encode_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            known, known_forms = read_state(batch.sparkSession, state_path, batch_id - 1)
        else:
            known, known_forms = mapping, forms
        result = encode_corpus(batch, mapping=known, forms=known_forms, **options)
        entries, seen = result.mapping, result.forms
        if batch_id % SNAPSHOT:
            entries = entries.join(result.seen.select("placeholder").distinct(), "placeholder", "left_semi")
            seen = result.seen
        for kind, rows, columns in (
            ("mapping", entries, E.MAPPING_COLUMNS), ("forms", seen, E.FORM_COLUMNS)
        ):
            rows.select(*columns).write.mode("overwrite").parquet(
                f"{state_path}/{kind}/version={batch_id}"
            )
        result.documents.select("doc_id", "sanitized").withColumn(
            "batch_id", F.lit(batch_id)
        ).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")
        if batch_id and batch_id % SNAPSHOT == 0:
            for kind in ("mapping", "forms"):
                drop_versions(batch.sparkSession, f"{state_path}/{kind}", batch_id - SNAPSHOT)

    return run


def encode_into_store(
    store: MappingStore, output_path: str, writer: str, **options: Any
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that replaces by a stored mapping, which other streams
    and batches may extend at the same time.

    ``writer`` names the stream, for good.  A micro-batch reads and writes the buckets of
    its keys only.  One that is run again finds its keys in the store: it gets the same
    placeholders and overwrites its output with the same content.  Its scratch tables are
    deleted with it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with own_scratch(batch.sparkSession):
            result = encode_corpus(batch, store=store, writer=writer, batch=batch_id, **options)
            result.documents.select("doc_id", "sanitized").withColumn(
                "batch_id", F.lit(batch_id)
            ).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return run
