"""Splice replacements into a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let

# Characters of a block.  Pieces are cut from blocks, for cutting walks from the begin
# of what it cuts from.
BLOCK = 1024

#: Texts up to this many characters are cut as they are.
SHORT = 4 * BLOCK


def splice(text: Column, edits: Column) -> Column:
    """Replace disjoint ranges; ``edits`` is ``array<struct<start, end, replacement>>``
    in text order.  A long text is cut into blocks once; each block is joined from the
    edits that start in it and the text between them."""

    def at_once(own: Column) -> Column:
        def between(upto: Column, i: Column) -> Column:
            since = F.coalesce(F.get(own, i - 1)["end"].cast("int"), F.lit(0))
            return F.substring(text, since + 1, F.greatest(upto - since, F.lit(0)))

        pieces = F.transform(
            own, lambda e, i: F.concat(between(e["start"].cast("int"), i), e["replacement"])
        )
        return F.concat(F.array_join(pieces, ""), between(F.length(text), F.size(own)))

    def rewrite(blocks: Column, own: Column) -> Column:
        last = F.size(blocks) - 1
        # Edits sorted in among marks, one at the head of each block: a mark's place
        # less its block is the number of edits before the block.
        heads = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("block"), F.lit(-1).alias("at"))
        )
        placed = F.transform(
            own,
            lambda e, i: F.struct(
                F.least(F.floor(e["start"] / BLOCK).cast("int"), last).alias("block"), i.alias("at")
            ),
        )
        marked = F.transform(
            F.array_sort(F.concat(heads, placed)),
            lambda m, p: F.struct(m["at"].alias("at"), (p - m["block"]).alias("before")),
        )
        return let(
            F.transform(F.filter(marked, lambda m: m["at"] < 0), lambda m: m["before"]),
            lambda before: F.array_join(
                F.transform(
                    blocks,
                    lambda block, b: joined(
                        block,
                        b * BLOCK,
                        F.get(own, F.get(before, b) - 1)["end"],
                        F.slice(
                            own,
                            F.get(before, b) + 1,
                            F.coalesce(F.get(before, b + 1), F.size(own)) - F.get(before, b),
                        ),
                    ),
                ),
                "",
            ),
        )

    def joined(block: Column, begin: Column, done: Column, edits_here: Column) -> Column:
        """A block from ``begin`` on, what is ``done`` left out, with its edits."""
        fresh = F.greatest(begin, F.coalesce(done.cast("int"), F.lit(0)))

        def piece(here: Column) -> Column:
            def between(upto: Column, i: Column) -> Column:
                since = F.coalesce(F.get(here, i - 1)["end"].cast("int"), fresh)
                return F.substring(block, since - begin + 1, F.greatest(upto - since, F.lit(0)))

            pieces = F.transform(
                here,
                lambda e, i: F.concat(between(e["start"].cast("int"), i), e["replacement"]),
            )
            rest = between(begin + F.length(block), F.size(here))
            return F.concat(F.array_join(pieces, ""), rest)

        return F.when((F.size(edits_here) == 0) & (fresh == begin), block).otherwise(
            let(edits_here, piece)
        )

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = let(cut, lambda blocks: let(edits, lambda own: rewrite(blocks, own)))
    only = F.array_join(F.transform(edits, lambda e: e["replacement"]), "")
    return (
        F.when(edits.isNull() | (F.size(edits) == 0), text)
        .when(text == "", only)
        .when(F.length(text) <= SHORT, let(edits, at_once))
        .otherwise(whole)
    )
