"""Substring dedup by hashing units of text.

A text is cut after line ends and after ``.``, ``!`` and ``?``; cut at lines only, a
passage that was put into the middle of a line would never be a unit.  Units are
normalised (A-Z in lower case, blanks as one space) and known by 128-bit digests,
grouped over all documents.  The occurrence of the smallest rank (doc_id, null last,
then place in the table, then place in the text) stays; later ones are removed if they
have ``UNIT_WORDS`` words or more, or lie in a run of repeated units of ``RUN_WORDS``, so
only short lines that stand alone are left.  Offsets are code points of the original text,
ends exclusive.

A digest that holds a large share of all units meets its first occurrence by broadcast,
the others by a shuffle in which no digest is large.

* Null and empty texts have no units.  Rows that repeat are documents of their own: the
  first stays whole, the others lose what they share with it.
* An empty table gives no spans.  Rows are pinned under neutral column names, so
  columns of the input cannot clash; ``removed`` and ``kept`` are added to the texts
  and replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import checked_broadcast, stored, written
from veilframe.operators.entities import lookup

UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
UNIT_WORDS, RUN_WORDS = 10, 30
BATCH_UNITS = 50_000

UNITS = "no_id boolean, {key}, rid long, idx int, start int, end int, words int, h1 long, h2 long"


def units_of(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """start, end, words, digest of each unit with a word."""
    for m in UNIT.finditer(text):
        words = m[0].encode("utf-8", "surrogatepass").lower().split()
        if words:
            yield m.start(), m.end(), len(words), xxhash.xxh3_128_digest(b" ".join(words))


def units(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row a unit of ``rows`` (with ``_rid``); a batch of units goes out when it is
    full, however long the texts."""
    slim = rows.select(
        F.col(doc_id).alias("doc_id"), F.col("_rid").alias("rid"), F.coalesce(text, F.lit("")).alias("text")
    )
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, texts = batch.column(0), batch.column(1), batch.column(2)
            owner: list[int] = []
            cells: list[tuple[int, int, int, int, bytes]] = []

            def out() -> pa.RecordBatch:
                own = pa.array(owner, pa.int32())
                idx, start, end, words, digest = zip(*cells)
                halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
                numbers = [pa.array(x, pa.int32()) for x in (idx, start, end, words)]
                keys = ids.take(own)
                return pa.RecordBatch.from_arrays(
                    [keys.is_null(), keys, rids.take(own), *numbers]
                    + [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)],
                    names=["no_id", "doc_id", "rid", "idx", "start", "end", "words", "h1", "h2"],
                )

            for i in range(batch.num_rows):
                for idx, unit in enumerate(units_of(texts[i].as_py())):
                    owner.append(i)
                    cells.append((idx, *unit))
                    if len(cells) >= BATCH_UNITS:
                        yield out()
                        owner, cells = [], []
            if cells:
                yield out()

    return slim.mapInArrow(cut, UNITS.format(key=f"doc_id {kind}"))


def repeated_spans(
    rows: DataFrame, doc_id: str, text: str, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """rid, doc_id, start, end, words, first_id: what later occurrences lose; first_id
    is the document that keeps the first unit of the span.  ``rows`` are read once."""
    cut = written(units(rows, doc_id, text), "units")
    rank = F.struct("no_id", "doc_id", "rid", "idx")
    firsts = written(
        cut.groupBy("h1", "h2")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.struct("h1", "h2").alias("h"), "first", "n"),
        "firsts",
    )
    keyed = cut.withColumn("h", F.struct("h1", "h2")).drop("h1", "h2")
    met = lookup(keyed, firsts.select("h", "first"), "h", firsts.select("h", "n"))
    later = met.where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(rank))
    line = Window.partitionBy("rid").orderBy("idx")
    run = Window.partitionBy("rid", "run")
    together = later.withColumn("run", F.col("idx") - F.row_number().over(line)).withColumn(
        "run_words", F.sum("words").over(run)
    )
    going = together.where((F.col("words") >= unit_words) | (F.col("run_words") >= run_words)).withColumn(
        "run", F.col("idx") - F.row_number().over(line)
    )
    return (
        going.groupBy("rid", "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("words"),
            F.min(F.struct("idx", "first.doc_id")).alias("from"),
        )
        .select("rid", "doc_id", "start", "end", "words", F.col("from.doc_id").alias("first_id"))
    )


def spans_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The spans alone; rows are numbered while they are read."""
    rows = docs.select(doc_id, text).withColumn("_rid", F.monotonically_increasing_id())
    return repeated_spans(rows, doc_id, text, **options)


def _without(text: Column, removed: Column) -> Column:
    @F.pandas_udf("text string, kept array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, gone in zip(texts, spans):
            if x is None or gone is None or not len(gone):
                out.append((x, [] if not x else [{"start": 0, "end": len(x)}]))
                continue
            edges = [0, *(e for s in gone for e in (s["start"], s["end"])), len(x)]
            stay = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
            out.append(("".join(x[a:b] for a, b in stay), [{"start": a, "end": b} for a, b in stay]))
        return pd.DataFrame(out, columns=["text", "kept"])

    return cut(text, removed)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with repeats cut out of the text; ``removed`` and ``kept`` are the spans
    of the original text that went and that stay, in order."""
    kept = stored(docs, "substring-input")
    spans = written(repeated_spans(kept.rows, kept.at(doc_id), kept.at(text), **options), "repeats")
    gone = spans.groupBy(F.col("rid").alias("_rid")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")
    )
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    marked = kept.rows.join(checked_broadcast(gone), "_rid", "left").withColumn(
        "removed", F.coalesce("removed", nothing)
    )
    cut = marked.withColumn("_cut", _without(F.col(kept.at(text)), F.col("removed")))
    cut = cut.withColumn(kept.at(text), F.col("_cut.text")).withColumn("kept", F.col("_cut.kept"))
    return kept.original(cut.drop("_cut", "_rid"), without=("removed", "kept"))
