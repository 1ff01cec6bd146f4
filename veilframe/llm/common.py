"""Helpers the corpus operators share: words, stored rows, checked broadcasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows of three or four short columns that are sent to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Runs of anything but blanks, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII only take the short way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, from a table in the shared scratch folder: it cuts the
    lineage, and no lost executor takes it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only after its rows were counted; else joined by shuffle.
    What it is made of should be short or written, as counting computes it."""
    return F.broadcast(df) if df.count() <= most else df


@dataclass(frozen=True)
class Stored:
    """Rows in a scratch table under plain names c0, c1, ..., so that no name of the
    input can clash; ``_rid`` names a row for good, whatever reads the table."""

    rows: DataFrame
    names: list[str]

    def at(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def original(self, df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
        """The columns under their first names; others follow, and replace those in
        ``without``."""
        own = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in without]
        added = [F.col(c) for c in df.columns if c not in self.rows.columns]
        return df.select(*own, *added)


#: Files and rows a file that a row id can name.
FILE_BITS, ROW_BITS = 28, 34


def stored(df: DataFrame, name: str, most_files: int | None = None) -> Stored:
    spark = df.sparkSession
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    path = scratch_path(spark, name)
    out = plain.coalesce(most_files) if most_files else plain
    out.write.option("maxRecordsPerFile", 0).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rid = F.shiftleft(part, ROW_BITS) + F.col("_metadata.row_index")
    return Stored(
        spark.read.schema(plain.schema).parquet(path).withColumn("_rid", rid), list(df.columns)
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 0 in the order given, without all rows in one task: sorted
    ranges are pinned, counted, and numbered from the sum of those before.  The order
    must be total."""
    ranged = written(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_part", "_start")
    )
