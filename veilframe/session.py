"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Column that ``pin_rows`` adds.
ROW = "_pinned_row"

#: Scratch tables of the ``own_scratch`` that is open in this thread.
_own: ContextVar[list[str] | None] = ContextVar("own_scratch", default=None)

DEFAULTS = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there: results used
    more than once are computed once, and survive the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    own = _own.get()
    if own is not None:
        own.append(path)
    return path


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, or when it fails, the scratch tables made inside, as they hold
    texts in clear.  Results must be written inside: frames that read these tables are of
    no use after.  Tables made before, or by other threads, stay."""
    own: list[str] = []
    token = _own.set(own)
    try:
        yield
    finally:
        _own.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


def pin_rows(df: DataFrame) -> DataFrame:
    """The rows from a scratch table, each with a number of its own in ``ROW``.

    Ids given by users may be null or repeat; the number comes from a row's file and
    place in it, so it is the same whenever and wherever the table is read.
    """
    path = scratch_path(df.sparkSession, "pinned")
    df.drop(ROW).write.option("maxRecordsPerFile", 0).parquet(path)
    file_no = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    row = F.shiftleft(file_no, 34) + F.col("_metadata.row_index")
    return df.sparkSession.read.schema(df.drop(ROW).schema).parquet(path).withColumn(ROW, row)
