"""Registered queries of the corpus operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    chat, contamination, langid, licenses, mixing, negatives, pii, quality, repair, secrets, sharding,
    simhash, sql, substrings,
)
from veilframe.llm.common import count_words, table, written

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = Query(run, oracle)
        return run

    return register


def joined(items) -> F.Column:
    return F.array_join(items, ",")


# --- 1: sharding ----------------------------------------------------------------------


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return sharding.shard(docs).select("*", F.lit(None).cast("int").alias("grown_shard"))


# --- 4: quality rules -------------------------------------------------------------------


@query("op4_quality", sql.QUALITY)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = quality.cascade_order(quality.profile(docs))
    return docs.select("doc_id", quality.report(F.col("text"), order).alias("r")).select("doc_id", "r.*")


# --- 7: mixing ------------------------------------------------------------------------


@query("op7_mixing", sql.MIXING)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(
        table(spark, sf_dir, "documents").select(
            "doc_id", "source", count_words(F.col("text")).alias("size"),
            mixing.document_key(F.col("doc_id"), F.col("text")).alias("key"),
        ),
        "sizes",
    )
    return mixing.with_copies(sized, F.col("key")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


# --- 8: chat formatting ------------------------------------------------------------------


@query("op8_chat", sql.CHAT)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    shown = chat.examples(turns.unionByName(added))
    masked = chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    whole = shown.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("longest"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("loss_start").isNotNull(), F.struct("target", masked.alias("masked")))
            )
        ).alias("masked"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    read = whole.withColumn("turns", chat.read_turns(F.col("longest"))).withColumn(
        "trained", F.array_join("masked.masked", "")
    )
    told_turns = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told_turns, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# --- 9: near-duplicates -----------------------------------------------------------------


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id"
    )


# --- 10: decontamination ----------------------------------------------------------------


@query("op10_decontamination", sql.CONTAMINATION)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_proximity")
def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items whose words stand together in any order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.proximity(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_near",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_near") > 0).alias("near"),
    )


# --- 2: secret scans -----------------------------------------------------------------------


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.secret_spans(F.col("text")).alias("all"))
    base = F.filter("all", lambda s: s.kind < len(secrets.BASE))

    def number(place: int) -> F.Column:
        return F.size(F.filter("all", lambda s: s.kind == place)).cast("long")

    counts = [number(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(secrets.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.named(base), 256).alias("base_sha256"),
        secrets.named(F.col("all")).alias("spans"),
    )


# --- 3: substring dedup ---------------------------------------------------------------------


@query("op3_substrings", sql.SUBSTRINGS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that go, with the document that keeps the passage."""
    return repeats(spark, sf_dir)


@query("op3_repeats", sql.REPEATS)
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated unit, however short."""
    return repeats(spark, sf_dir, unit_words=1)


def repeats(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    spans = substrings.spans_table(table(spark, sf_dir, "documents").select("doc_id", "text"), **options)
    return spans.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "words")], "first_id"
    )


# --- 6: language identification ---------------------------------------------------------------


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(docs.where(fold != 1))
    return docs.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        langid.predicted(F.col("text"), model).alias("p"),
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


# --- 5: license scans --------------------------------------------------------------------------


@query("op5_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", licenses.licenses(F.col("text")).alias("f")).select(
        "doc_id", "f.n_words", "f.n_base", "f.first_word", "f.last_word", "f.base_labels",
        "f.labels", "f.score",
    )


# --- 11: hard negatives -------------------------------------------------------------------------


@query("op11_negatives", sql.NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, vector="embedding")


# --- 12: conversation structure repair ------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as the contract damages them, by a checksum of conversation and turn."""
    blank = F.lit(" ")
    said = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(F.concat_ws(":", *said)) % 20).alias("harm"),
    )
    text = (
        F.when(F.col("harm") == 1, "")
        .when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("col")


@query("op12_repair", sql.REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = repair.reports(repair.repair(damaged(turns))).withColumnRenamed("conv_id", "own_id")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.COUNTS]
    return every.join(told, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"),
    )


# --- 13: personal data ----------------------------------------------------------------------------


@query("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.personal_spans(F.col("text")).alias("all"))
    base = F.filter("all", lambda s: s.kind < len(pii.BASE))

    def number(place: int) -> F.Column:
        return F.size(F.filter("all", lambda s: s.kind == place)).cast("long")

    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(pii.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.named(base), 256).alias("base_sha256"),
        pii.named(F.col("all")).alias("spans"),
    )
