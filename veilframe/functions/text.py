"""Text preparation and comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let
from veilframe.operators.rules import CHUNK_CHARS, LINE_JOIN_PARTICLES


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+\z", "")


def join_broken_names(text: Column) -> Column:
    """Join a line that ends in a name particle with the capitalised word below.

    One replacement per particle, in this order: neighbouring pairs share a word and a
    pass that takes the words would join only the first of them.  A pass that looks ahead
    to the word does the same for all particles, but where a particle follows itself.
    """
    one_by_one = text
    for particle in LINE_JOIN_PARTICLES:
        one_by_one = F.regexp_replace(one_by_one, rf"(?U)\b({particle})\n([A-Z][A-Za-z]+)", "$1 $2")
    any_of = "|".join(LINE_JOIN_PARTICLES)
    at_once = F.regexp_replace(text, rf"(?U)(?=[A-Z])\b({any_of})\n(?=[A-Z][A-Za-z])", "$1 ")
    return F.when(text.rlike(rf"({any_of})\n\1"), one_by_one).otherwise(at_once)


def chunk_bounds(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Chunks ``array<struct<start, end>>`` cut at paragraph, then sentence ends.

    Inside the text a chunk ends after its last blank line if that lies past the
    middle, else after its last ". " past the middle, else after ``size``
    characters.  Each step knows only the previous cut, hence a fold; a chunk is
    longer than half the size, which bounds the number of steps.
    """
    half = size // 2
    bounds_type = "array<struct<start:int,end:int>>"

    def cut(acc: Column, total: Column) -> Column:
        window = F.substring(text, acc["pos"] + 1, F.lit(size))

        def end_of(w: Column) -> Column:
            para = F.length(w) - F.length(F.substring_index(w, "\n\n", -1)) - 2
            sent = F.length(w) - F.length(F.substring_index(w, ". ", -1)) - 2
            return (
                F.when(acc["pos"] + size >= total, total)
                .when(para > half, acc["pos"] + para + 2)
                .when(sent > half, acc["pos"] + sent + 2)
                .otherwise(acc["pos"] + size)
            )

        end = let(window, end_of)
        return let(
            end,
            lambda e: F.struct(
                e.alias("pos"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(acc["pos"].alias("start"), e.alias("end"))),
                ).alias("out"),
            ),
        )

    def walk(total: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(total / max(half, 1)).cast("int"))
        state = F.struct(F.lit(0).alias("pos"), F.array().cast(bounds_type).alias("out"))
        return F.aggregate(
            steps,
            state,
            lambda acc, _: F.when(acc["pos"] >= total, acc).otherwise(cut(acc, total)),
            lambda acc: acc["out"],
        )

    return let(F.length(text), walk)


def fixed_chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive pieces of ``size`` characters."""
    starts = F.when(
        F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing character; null if there is none
    within the shorter text.  Binary search over equal prefixes."""
    shorter = F.least(F.length(a), F.length(b))

    def search(n: Column) -> Column:
        state = F.struct(F.lit(0).alias("same"), n.alias("differ"))

        def halve(acc: Column, _: Column) -> Column:
            mid = ((acc["same"] + acc["differ"] + 1) / 2).cast("int")
            equal = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
            return F.when(
                acc["same"] >= acc["differ"], acc
            ).otherwise(
                F.when(equal, F.struct(mid.alias("same"), acc["differ"].alias("differ"))).otherwise(
                    F.struct(acc["same"].alias("same"), (mid - 1).alias("differ"))
                )
            )

        found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, halve, lambda x: x["same"])
        return let(found, lambda f: F.when(f < n, f))

    return let(shorter, search)
