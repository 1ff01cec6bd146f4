"""Pages, parts and chunks of converted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import let
from veilframe.functions.text import chunk_bounds, fixed_chunks, strip
from veilframe.operators.rules import (
    CHUNK_CHARS,
    PAGE_MARKER,
    PAGES_PER_PART,
    SCAN_PAGE_MAX_CHARS,
)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_no, text)`` to one text per document, each page under
    a marker line.  A group is the pages of one document, which is the result."""
    page = F.concat(
        F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text")
    )
    return pages.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_no", page.alias("page")))),
                lambda p: p["page"],
            ),
            "\n\n",
        ).alias("text")
    )


def page_texts(text: Column) -> Column:
    """Trimmed, non-blank pages between markers."""
    return F.filter(
        F.transform(F.split(text, f"(?U){PAGE_MARKER}", -1), strip), lambda p: p != ""
    )


def split_pages(docs: DataFrame) -> DataFrame:
    """One row per non-blank page, numbered after blank ones are dropped."""
    rows = docs.select("doc_id", F.posexplode_outer(page_texts(F.col("text"))))
    return rows.where(F.col("col").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).alias("page_no"), F.col("col").alias("text")
    )


def page_parts(
    docs: DataFrame, max_pages: int = PAGES_PER_PART, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Pages grouped into parts of ``max_pages``; a text without any page is cut
    into chunks of ``chunk_chars`` characters, which then count as pages."""
    pages = let(
        page_texts(F.col("text")),
        lambda p: F.when(F.size(p) == 0, fixed_chunks(F.col("text"), chunk_chars)).otherwise(p),
    )
    parts = let(
        pages,
        lambda p: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(p), F.lit(max_pages)),
                lambda i: F.array_join(F.slice(p, i, max_pages), "\n\n"),
            )
        ),
    )
    rows = docs.select("doc_id", F.posexplode_outer(parts))
    return rows.where(F.col("col").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).alias("part_no"), F.col("col").alias("text")
    )


def character_chunks(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode_outer(fixed_chunks(F.col("text"), size)))
    return rows.where(F.col("col").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).alias("chunk_no"), F.col("col").alias("text")
    )


def paragraph_chunks(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """Chunks for a model with limited input: one row per chunk with its offset."""
    rows = docs.select("doc_id", "text", F.posexplode_outer(chunk_bounds(F.col("text"), size)))
    return rows.where(F.col("col").isNotNull()).select(
        "doc_id",
        (F.col("pos") + 1).alias("chunk_no"),
        F.col("col.start").alias("chunk_start"),
        F.col("col.end").alias("chunk_end"),
        F.substring(
            F.col("text"), F.col("col.start") + 1, F.col("col.end") - F.col("col.start")
        ).alias("text"),
    )


def shift_chunk_spans(chunk_spans: DataFrame) -> DataFrame:
    """Spans found in chunks, moved to offsets in the whole text."""
    return chunk_spans.withColumn("start", F.col("start") + F.col("chunk_start")).withColumn(
        "end", F.col("end") + F.col("chunk_start")
    )


def page_kind(text: Column) -> Column:
    """A page with next to no text of its own is a scan."""
    return F.when(F.length(strip(text)) < SCAN_PAGE_MAX_CHARS, F.lit("scan")).otherwise(
        F.lit("native")
    )


def convert_report(pages: DataFrame) -> DataFrame:
    """Page counts and text length per document.  Scans are counted, but with no
    recognition engine in the loop none of them is read by one."""
    kinds = pages.withColumn("kind", page_kind(F.col("text")))
    marker = F.length(F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n")))
    return kinds.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.sum(F.when(F.col("kind") == "scan", 1).otherwise(0)).alias("scan_pages"),
        F.count(F.lit(1)).alias("native_pages"),
        F.lit(0).alias("ocr_pages"),
        (F.sum(marker + F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("text_length"),
    )
