"""Spans in a text as array columns: finding, comparing, choosing.

A span is ``struct<start, end, category, confidence, value, ctx_from, ctx_to>``
with 0-based, end-exclusive code-point offsets; an array of spans is in list
order, which decides ties.  Everything here works inside one row, so a scan over
documents finds and resolves its spans without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let, running, runs
from veilframe.operators.rules import MASKED_VALUE, Rule

# Four marks delimit lead, value and trail of a match inside the marked text, or two the
# value of a match that is nothing else.
MARK = "\u0001"
MARKED_GROUPS = f"{MARK}$1{MARK}$2{MARK}$3{MARK}"
MARKED_MATCH = f"{MARK}$0{MARK}"
MARKED_IN_GROUPS = f"{MARK}{MARK}$0{MARK}{MARK}"

HIT_TYPE = "struct<rule:int,lead:int,start:int,end:int,stop:int,value:string>"
SPAN_TYPE = (
    "struct<start:int,end:int,category:string,confidence:double,value:string,"
    "ctx_from:int,ctx_to:int>"
)
NO_HITS = f"cast(array() AS array<{HIT_TYPE}>)"
NO_SPANS = f"cast(array() AS array<{SPAN_TYPE}>)"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN_TYPE}>")


# Word characters are letters, numbers and the underscore.  The JVM's notion of a
# word boundary differs for numbers that are no digits, and for marks, joiners
# and enclosed letters; one stand-in letter and one stand-in sign settle that.
# ASCII is told apart first, whose types need no lookup.
OTHER_NUMBERS = r"[\x{80}-\x{10FFFF}&&[\p{No}]]"
NOT_LETTERS = (
    r"[\x01\x{300}-\x{10FFFF}&&[\x01\p{M}\x{200C}\x{200D}\x{203F}\x{2040}\x{2054}\x{FE33}\x{FE34}\x{FE4D}-\x{FE4F}"
    r"\x{FF3F}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]]"
)


def scannable(text: Column) -> Column:
    """The text as rules see it: no mark character, the same word characters
    everywhere, offsets unchanged.  No rule matches a replaced character."""
    return F.regexp_replace(F.regexp_replace(text, OTHER_NUMBERS, "ª"), NOT_LETTERS, "·")


# --- finding: SQL expressions over a text column -------------------------------------
# These are written as SQL text rather than with the Column API: a detector is a
# few hundred constants, and each Column call is a round trip to the JVM.


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Sequence[str]) -> str:
    return ", ".join(literal(v) for v in values)


def bind(value: str, name: str, body: str) -> str:
    """SQL form of ``arrays.let``."""
    return f"aggregate(cast(array() AS array<int>), {value}, ({name}, none) -> {name}, {name} -> {body})"


# Pieces of marked text that are walked in one go.  Their number is a multiple of four,
# so every stretch begins with a gap.
STRETCH = 512


def _read_marks(copies: str, text: str, in_groups: bool) -> str:
    """Marked copies of a text, one a rule, to hits.  A copy that is null or the text itself
    has none.  A piece of text and a gap take turns, or lead, value, trail and gap
    if the marks are ``in_groups``.

    A copy is cut once and walked hit by hit: the gap behind a hit says where the next one
    begins, so the length of a gap is counted once.  Each stretch of pieces is walked on its
    own, from the sum of the lengths before it, so that growing the list of hits stays
    cheap.  There are as few lambdas as can be: the analyzer takes some rounds for each that
    waits for another, and may take a hundred."""
    step = 4 if in_groups else 2

    def walked(pieces: str, begin: str) -> str:
        def at(place: int) -> str:
            return f"{pieces}[i * {step} + {place}]"

        if in_groups:
            value, ends = at(2), [f"length({at(k)})" for k in (1, 2, 3)]
        else:
            value, ends = at(1), ["0", f"length({at(1)})", "0"]
        places = ["acc.lead"]
        for more in ends:
            places.append(places[-1] if more == "0" else f"{places[-1]} + {more}")
        lead, start, end, stop = places
        hit = (
            f"named_struct('rule', rule, 'lead', {lead}, 'start', {start}, 'end', {end}, "
            f"'stop', {stop}, 'value', {value})"
        )
        return (
            f"aggregate(sequence(0, (size({pieces}) - 1) div {step} - 1), "
            f"named_struct('lead', {begin} + length({pieces}[0]), 'hits', {NO_HITS}), (acc, i) -> named_struct("
            f"'lead', {stop} + length({at(step)}), 'hits', array_append(acc.hits, {hit})), acc -> acc.hits)"
        )

    own = f"slice(pieces, j * {STRETCH} + 1, {STRETCH})"
    with_gap = f"slice(pieces, j * {STRETCH} + 1, {STRETCH} + 1)"
    in_stretches = (
        f"aggregate(sequence(0, (size(pieces) - 2) div {STRETCH}), "
        f"named_struct('pos', 0, 'out', cast(array() AS array<array<{HIT_TYPE}>>)), (sofar, j) -> named_struct("
        f"'pos', sofar.pos + length(array_join({own}, '')), 'out', array_append(sofar.out, "
        + bind(with_gap, "some", walked("some", "sofar.pos"))
        + ")), sofar -> flatten(sofar.out))"
    )
    walk = f"if(size(pieces) <= {STRETCH} + 1, {walked('pieces', '0')}, {in_stretches})"
    cut = f"split(marked, '{MARK}', -1)"
    return (
        f"flatten(transform({copies}, (marked, rule) -> if(marked IS NULL OR marked = {text}, {NO_HITS}, "
        f"{bind(cut, 'pieces', walk)})))"
    )


def scan(text: str, rules: Sequence[Rule], gate: str | None = None) -> str:
    """All hits of all rules: rule order first, then text order.

    Each rule marks its matches in a copy of the text; a rule that matches
    nothing returns the text itself and is not walked.  ``gate`` is a cheap
    necessary condition which skips the rules for most texts, as are the needs
    of single rules; a regex several rules need is tested once.
    """
    shared = list(dict.fromkeys(r.needs_regex for r in rules if r.needs_regex))
    in_groups = any(r.in_groups for r in rules)

    def copy(rule: Rule) -> str:
        marks = MARKED_GROUPS if rule.in_groups else MARKED_IN_GROUPS if in_groups else MARKED_MATCH
        replaced = f"regexp_replace({text}, {literal(rule.jvm_regex())}, '{marks}')"
        if rule.needs:
            held = " OR ".join(f"contains({text}, {literal(n)})" for n in rule.needs)
            replaced = f"if({held}, {replaced}, {text})"
        if rule.needs_regex:
            replaced = f"if(need_{shared.index(rule.needs_regex)}, {replaced}, {text})"
        return replaced

    hits = _read_marks(f"array({', '.join(copy(r) for r in rules)})", text, in_groups)
    for i, regex in enumerate(shared):
        hits = bind(f"{text} RLIKE {literal('(?U)' + regex)}", f"need_{i}", hits)
    return hits if gate is None else f"if({gate}, {hits}, {NO_HITS})"


def words_of(text: str) -> str:
    return f"split(lower({text}), {literal(NOT_WORD)})"


def scan_names(
    text: str, names: Sequence[str], tail: str = "", words: str | None = None
) -> str:
    """Hits of every dictionary name in any case, each searched on its own.

    Names are looked up by a word they must contain (their longest): the words
    of the text (``words``, if at hand) are tested against a hash set, and only
    names whose word occurs are searched.  One alternation of all names would be quicker still
    but would lose names that overlap one another.
    """
    ordered = sorted(names)
    keys = [_longest_word(n) for n in ordered]
    # A constant pattern each, which the JVM compiles once.
    marked = ", ".join(
        f"if(array_contains(present, {literal(k)}), "
        f"regexp_replace({text}, {literal(name_regex(n, tail))}, {literal(MARKED_MATCH)}), NULL)"
        for n, k in zip(ordered, keys)
    )
    present = f"array_distinct(filter({words or words_of(text)}, w -> w IN ({literals(sorted(set(keys)))})))"
    search = _read_marks(f"array({marked})", text, False)
    return bind(present, "present", f"if(size(present) = 0, {NO_HITS}, {search})")


NOT_WORD = r"[^\p{L}\p{N}_]+"


def name_regex(name: str, tail: str = "") -> str:
    return rf"(?iuU)(?=\Q{name[0]}\E)\b\Q{name}\E{tail}\b"


def _longest_word(name: str) -> str:
    cleaned = "".join(c if c.isalnum() or c == "_" else " " for c in name.lower())
    return max(cleaned.split(), key=len)


def to_spans(
    hits: str,
    category: str,
    confidence: str,
    where: str | None = None,
    left: int = 20,
    right: int = 20,
    around_match: bool = False,
) -> str:
    """Hits ``h`` that satisfy ``where``, as spans; the context window surrounds
    the value or the whole match."""
    begin, end = ("h.lead", "h.stop") if around_match else ("h.start", "h.`end`")
    chosen = hits if where is None else f"filter({hits}, h -> {where})"
    return (
        f"transform({chosen}, h -> named_struct('start', h.start, 'end', h.`end`, "
        f"'category', '{category}', 'confidence', cast({confidence} AS double), 'value', h.value, "
        f"'ctx_from', {begin} - {left}, 'ctx_to', {end} + {right}))"
    )


OVERLAP_SQL = "({0}.`end` > {1}.start AND {0}.start < {1}.`end`)"
SAME_PLACE_SQL = "({0}.start = {1}.start AND {0}.`end` = {1}.`end`)"


# --- comparing and choosing: columns of spans -------------------------------------------


def overlaps(a: Column, b: Column) -> Column:
    """Half-open interval test."""
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def same_place(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def without(spans: Column, taken: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Anti join inside a row: spans for which ``test`` holds with no taken span."""
    return let(
        taken, lambda t: F.filter(spans, lambda s: ~F.exists(t, lambda u: test(s, u)))
    )


def keep_free(spans: Column, taken: Column) -> Column:
    """Spans in list order that overlap no taken span nor an earlier kept one."""
    free = without(spans, taken, overlaps)
    return F.aggregate(
        free,
        no_spans(),
        lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(s, k)), acc).otherwise(
            F.concat(acc, F.array(s))
        ),
    )


def first_per_place(spans: Column) -> Column:
    """Exact-position dedup: of spans at one place the first in list order stays."""
    keyed = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), i.alias("ord"), s.alias("span")
            ),
        )
    )
    firsts = let(
        keyed,
        lambda k: F.filter(
            k,
            lambda x, i: (i == 0) | ~same_place(x, F.get(k, i - 1)),
        ),
    )
    in_order = F.array_sort(
        F.transform(firsts, lambda x: F.struct(x["ord"].alias("ord"), x["span"].alias("span")))
    )
    return F.transform(in_order, lambda x: x["span"])


def resolve_overlaps(spans: Column) -> Column:
    """Greedy choice of disjoint spans, returned in text order.

    Priority is confidence, then length, then list order.  The spans are first
    cut into islands (maximal groups connected by overlap) where one starts behind
    the furthest end before it; the greedy choice never looks across islands, so its
    quadratic part is limited to a handful of spans.
    """
    keyed = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].alias("start"),
                (-s["confidence"]).alias("rank1"),
                (s["start"] - s["end"]).alias("rank2"),
                i.alias("rank3"),
                s.alias("span"),
            ),
        )
    )
    def reached(items: Column) -> Column:
        """The furthest end up to each span."""
        return running(
            F.transform(items, lambda x: x["span"]["end"]), F.lit(-1), lambda a, x: F.greatest(a, x)
        )

    islands = let(
        keyed,
        lambda items: let(
            reached(items),
            lambda reach: runs(items, lambda _, i: F.get(items, i)["start"] >= F.get(reach, i - 1)),
        ),
    )

    def choose(island: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                island,
                lambda x: F.struct(
                    x["rank1"].alias("rank1"),
                    x["rank2"].alias("rank2"),
                    x["rank3"].alias("rank3"),
                    x["span"].alias("span"),
                ),
            )
        )
        return F.aggregate(
            ranked,
            no_spans(),
            lambda acc, x: F.when(
                F.exists(acc, lambda k: overlaps(x["span"], k)), acc
            ).otherwise(F.concat(acc, F.array(x["span"]))),
        )

    chosen = F.flatten(
        F.transform(
            islands,
            lambda isl: F.when(F.size(isl) <= 1, F.transform(isl, lambda x: x["span"])).otherwise(
                choose(isl)
            ),
        )
    )
    return F.array_sort(chosen)


def is_masked(value: Column) -> Column:
    return value.rlike(MASKED_VALUE)


def unmasked(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~is_masked(s["value"]))


def in_categories(
    spans: Column, categories: Sequence[str] | None = None, min_confidence: float | None = None
) -> Column:
    """Category and confidence filter."""

    def wanted(s: Column) -> Column:
        ok = F.lit(True)
        if categories is not None:
            ok = ok & s["category"].isin(list(categories))
        if min_confidence is not None:
            ok = ok & (s["confidence"] >= min_confidence)
        return ok

    return F.filter(spans, wanted)


def snippet(text: Column, ctx_from: Column, ctx_to: Column) -> Column:
    """Text around a span, clipped at both ends of the text."""
    begin = F.greatest(ctx_from, F.lit(0))
    return F.substring(text, begin + 1, ctx_to - begin)
