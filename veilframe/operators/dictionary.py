"""Names of a dictionary table found in texts by an index, however many names there are.

``names(name)`` is a table.  Each name is filed under its rarest word; the words of the
texts, with their places, are joined with these; a candidate is a name placed where its
word stands, and is kept if the text there is the name in any case, between word
boundaries.  Every name is searched on its own, as the rules for constant lists do: names
may overlap one another, matches of one name never do.

Texts are cut into pieces behind characters that no name holds, so a row stays small
however long a text is; a name that holds one of them is an error.  A name without a word
is never found.  Names equal but for case are one name.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.search import WORD
from veilframe.operators import pieces as PC
from veilframe.operators.intervals import resolve_rows
from veilframe.session import ROW, cut_lineage, pin_rows

#: Most bytes of names that are sent to every executor.
BROADCAST_BYTES = 32 << 20

TEXTS_AT_ONCE = 256


def _places(texts: pa.Array) -> pa.Array:
    """Words of each text with their places, both flat, cut into lists by text."""
    words: list[str] = []
    at: list[int] = []
    ends = [0]
    for text in texts.to_pylist():
        for m in WORD.finditer(text or ""):
            words.append(m.group())
            at.append(m.start())
        ends.append(len(words))
    structs = pa.StructArray.from_arrays(
        [pa.array(words, pa.string()), pa.array(at, pa.int32())], names=["word", "at"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def words_at(text: Column) -> Column:
    """Words of a text, in small letters, with their places: ``struct<word, at>``."""

    def placed(texts: pa.Array) -> pa.Array:
        starts = range(0, len(texts), TEXTS_AT_ONCE)
        return pa.concat_arrays([_places(texts.slice(i, TEXTS_AT_ONCE)) for i in starts or [0]])

    found = F.arrow_udf(placed, "array<struct<word:string,at:int>>")(text)
    return F.transform(found, lambda w: F.struct(F.lower(w["word"]).alias("word"), w["at"].alias("at")))


def index(names: DataFrame) -> DataFrame:
    """``name`` (small letters), ``word`` it is filed under, ``ahead`` (characters of the
    name before that word) and ``size``."""
    lower = F.lower(S.scannable(F.col("name")))
    # A stand-in for the end of a sentence sees the blank behind a name, too.
    barrier = F.concat(lower, F.lit(" ")).rlike(PC.BARRIER)
    checked = F.when(barrier, F.raise_error(F.concat(F.lit("a name may not hold a barrier: "), F.col("name"))))
    plain = names.where(F.col("name").isNotNull()).select(F.coalesce(checked.cast("string"), lower).alias("name")).distinct()
    words = cut_lineage(plain.select("name", F.inline(words_at(F.col("name")))))
    uses = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    best = F.min_by(F.struct("word", "at"), F.struct("uses", -F.length("word"), "at"))
    return words.join(uses, "word").groupBy("name").agg(best.alias("w")).select(
        "name", F.col("w.word").alias("word"), F.col("w.at").alias("ahead"), F.length("name").alias("size")
    )


def find_names(docs: DataFrame, names: DataFrame, keys: Sequence[str] = ("doc_id",), tail: str = "") -> DataFrame:
    """``keys, start, end, value, name``: matches of every name, and of the pattern ``tail``
    behind it, as the constant lists find them."""
    filed = cut_lineage(index(names))
    size = filed.agg(F.sum(F.octet_length("name") + F.octet_length("word") + 24)).first()[0] or 0
    filed = F.broadcast(filed) if size <= BROADCAST_BYTES else filed
    pinned = pin_rows(docs.select(*keys, "text"))
    cut = pinned.select(*keys, ROW, F.inline(PC.pieces(F.col("text"))))
    cut = cut_lineage(cut.withColumn("scan", S.scannable(F.col("text"))))
    place = [ROW, "piece"]
    found = (
        cut.select(*place, F.inline(words_at(F.col("scan"))))
        .join(filed, "word")
        .select(*place, "name", (F.col("at") - F.col("ahead")).alias("from"), "size")
        .where("`from` >= 0")
    )
    asked = found.groupBy(*place).agg(F.collect_set(F.struct("name", "from", "size")).alias("asked"))

    def judged(a: Column) -> Column:
        there = F.substr(F.col("scan"), a["from"] + 1, a["size"])
        # From the character before the name; from its last one, with what follows.
        before = F.substr(F.col("scan"), F.greatest(a["from"], F.lit(1)), F.when(a["from"] > 0, 2).otherwise(1))
        rest = F.substr(F.col("scan"), a["from"] + a["size"])
        begins = F.when(a["from"] > 0, before.rlike(r"(?sU)^.\b")).otherwise(before.rlike(r"(?U)^\b"))
        pattern = rf"(?siuU)^.({tail})\b"
        more = F.length(F.regexp_extract(rest, pattern, 1))
        fits = (F.lower(there) == a["name"]) & begins & rest.rlike(pattern)
        return F.when(fits, F.struct(a["name"].alias("name"), a["from"].alias("from"), (a["from"] + a["size"] + more).alias("to")))

    # What starts in the characters shown from before belongs to the piece before.
    own = F.filter(
        F.transform("asked", judged), lambda m: m.isNotNull() & (m["from"] >= F.col("shown"))
    )
    shift = F.col("begin") - F.col("shown")
    rows = cut.join(asked, place).select(
        *keys, ROW,
        F.inline(
            F.transform(
                own,
                lambda m: F.struct(
                    (m["from"] + shift).cast("int").alias("start"),
                    (m["to"] + shift).cast("int").alias("end"),
                    F.substr(F.col("text"), m["from"] + 1, m["to"] - m["from"]).alias("value"),
                    m["name"].alias("name"),
                ),
            )
        ),
    )
    return one_name_apart(cut_lineage(rows)).drop(ROW)


def one_name_apart(rows: DataFrame) -> DataFrame:
    """Matches of one name that do not overlap, the leftmost first."""
    line = Window.partitionBy(ROW, "name").orderBy("start")
    marked = cut_lineage(rows.withColumn("_late", F.lag("end").over(line) > F.col("start")))
    touched = marked.where("_late").select(ROW, "name").distinct()
    if touched.isEmpty():
        return marked.drop("_late")
    crossing = marked.join(touched, [ROW, "name"], "left_semi").drop("_late")
    key = F.struct(ROW, "name")
    chosen = resolve_rows(crossing.withColumn("_match", key), "_match", [F.col("start")]).drop("_match")
    return marked.join(touched, [ROW, "name"], "left_anti").drop("_late").unionByName(chosen.select(crossing.columns))
