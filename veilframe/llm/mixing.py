"""Mixing sources to target weights: repetition rates and seeded copies.

Sizes are summed per source, targets are shares of the whole by weight with a cap
per source, and a document is taken floor(rate) times plus one more time when its
hash falls below the fraction of the rate.

* A null source is a source of its own, last in order; a null size counts 0.
* The hash covers ``key`` only: rows that repeat with the same key share one draw.
* Documents of size 0 are copied like others of their source; a source of size 0
  has target 0 and its documents are not taken.
* Words of whole texts are counted where the texts lie; only sizes and keys are shuffled,
  so a very long text is a row like others.  Sources that tie do not arise: each is one row.
* An empty table gives an empty result.  Columns of the input named ``source_size``,
  ``target``, ``rate`` or ``copies`` are replaced by those of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import checked_broadcast, count_words, numbered, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
DRAWS = 1 << 48  # a draw is 12 hex digits of an MD5


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(DRAWS))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: of ``sized`` (source, size), one row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(sums, [F.col("source").asc_nulls_last()], "_at")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int")
    )
    sources = written(ordered.select("source", "source_size", weight.alias("weight")), "sources")
    level = fill_level(sources, cap)
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def fill_level(sources: DataFrame, cap: int) -> float:
    """Words per unit of weight for sources below their cap.  Every round caps the
    sources the level has passed and shares the rest anew, until none is above."""
    most = F.lit(cap) * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not whole["n"]:
        return 0.0
    level, capped = whole["n"] / whole["w"], -1
    while True:
        over = most < F.lit(level) * F.col("weight")
        now = sources.agg(
            F.count_if(over).alias("capped"),
            F.sum(F.when(over, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now["capped"] == capped or not now["open"]:
            return level
        level, capped = (whole["n"] - now["fixed"]) / now["open"], now["capped"]


def with_copies(
    docs: DataFrame,
    key: Column,
    source: str = "source",
    size: str = "size",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """Adds source_size, target, rate and copies (how often the mix takes the row)."""
    docs = docs.drop("source_size", "target", "rate", "copies")
    sized = docs.select(
        F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")
    )
    shares = targets(sized, weights, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        docs.withColumn("_draw", draw(key, seed))
        .join(checked_broadcast(shares), F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("rate", rate)
        .withColumn(
            "copies",
            F.floor("rate") + (F.col("_draw") < F.col("rate") - F.floor("rate")).cast("long"),
        )
        .drop("_source", "_draw")
    )


def document_key(doc_id: Column, text: Column) -> Column:
    """Of doc_id and text: rows without an id draw by their text."""
    named = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat_ws(":", named, F.md5(F.coalesce(text, F.lit(""))))


def mix_documents(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options
) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its columns; sizes are
    words.  Rows carry neutral names meanwhile, so no column is replaced."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{docs.columns.index(name)}" for name in (doc_id, source, text)}
    sized = plain.withColumn("size", count_words(F.col(at[text])))
    key = document_key(F.col(at[doc_id]), F.col(at[text]))
    taken = with_copies(sized, key, source=at[source], **options).where("copies > 0")
    copied = taken.select(*plain.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copied.select(*plain.columns).toDF(*docs.columns)
