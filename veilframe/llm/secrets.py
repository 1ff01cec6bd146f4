r"""Secrets in texts: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a long run of characters of a class that holds a letter.  A window
slides over it and its counts of the class's characters go along, packed into a few longs:
a move lowers the count of the character that leaves, raises that of the one that enters,
and changes the entropy by what these two counts say.  Long candidates are walked in
blocks of windows, whose stretches are joined again.  Windows at or above the class's
threshold are merged into spans.  The allow list takes runs that are a UUID as a whole,
and of other runs the parts between ``/ = _ -`` that hold a word such as ``example`` or
a counting sequence: they count as blanks, and what is left is searched.

All positions are code points, ends exclusive.  Matches never hold a line feed or any
other blank but U+0020, and are searched in whole texts.

* A null text is empty; an empty text has no spans.  Rows are scanned one by one, so
  repeated rows get equal spans; an empty table gives an empty result.
* Spans of one start go by the order of the kinds; spans of different kinds may overlap.
* The result is a column expression; no name of the input is touched.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
#: Kind, pattern, part the length counts for, least length; in the order of ties.
BASE = (
    ("assign", f"{KEYWORDS}[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
)

#: Kind, characters, shortest candidate, window, least entropy in bits.
CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", 20, 20, 3.0),
    ("entropy_base64", "A-Za-z0-9+/=_-", 20, 20, 3.7),
)

UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ALLOWED_WORD = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|0123456789|abcdefgh"
ALLOWED = f"(?i)^{UUID[4:]}$|{ALLOWED_WORD}"
#: What ends a part of a run.
BREAKS = "/=_-"

KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in CLASSES)

#: Items summed in one go when positions are added up; keeps long lists linear.
STEP = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(items: Column, start: Column) -> Column:
    """``start``, then sums of it and the items up to each."""
    append = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    return F.aggregate(items, F.array(start.cast("long")), append)


def _running(values: Column) -> Column:
    """Sums of each value and all before it.  Values are summed by steps first, so the
    work does not grow with the square of their number."""
    last_step = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / STEP).cast("int")
    steps = F.transform(
        F.sequence(F.lit(0), last_step), lambda i: F.slice(values, i * STEP + 1, F.lit(STEP))
    )

    def inside(steps: Column) -> Column:
        totals = F.transform(steps, lambda s: F.element_at(_sums(s, F.lit(0)), -1))
        return _let(
            _sums(totals, F.lit(0)),
            lambda starts: F.flatten(
                F.transform(
                    steps,
                    lambda s, i: F.slice(_sums(s, F.get(starts, i)), F.lit(2), F.size(s) + 1),
                )
            ),
        )

    return _let(steps, inside)


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, match) of a pattern's matches.  The texts between them are one
    more than the matches."""

    def pair(matches: Column) -> Column:
        return _let(
            F.split(text, pattern),
            lambda gaps: F.transform(
                matches,
                lambda m, i: F.struct(
                    (F.length(F.get(gaps, i)) + F.length(m)).cast("long").alias("step"), m.alias("match")
                ),
            ),
        )

    def place(found: Column) -> Column:
        return _let(
            _running(found["step"]),
            lambda ends: F.transform(
                found,
                lambda p, i: F.struct(
                    (F.get(ends, i) - F.length(p["match"])).alias("start"), p["match"].alias("match")
                ),
            ),
        )

    return _let(_let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair), place)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("long").alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        end.cast("long").alias("end"),
    )


NONE = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    fits = lambda p: F.length(F.regexp_extract(p["match"], pattern, group)) >= least
    if pattern.startswith("(?<!"):  # a match alone has its length already
        fits = lambda p: F.length(p["match"]) >= least
    kept = F.filter(_placed(text, pattern), fits)
    spans = F.transform(kept, lambda p: _span(kind, p.start, p.start + F.length(p["match"])))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(NONE))


# --- entropy -----------------------------------------------------------------------------


#: Counts have five bits each, twelve to a long; so a window has 31 characters at most.
COUNT_BITS, COUNTS_PER_LONG = 5, 12
#: Windows of a block, a power of two.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS

STRETCHES = "array<struct<from:int,to:int>>"


def _codes(chars: str) -> list[int]:
    """Where the count of each ASCII character of the class lies: number of its long,
    times 64, plus the shift in it."""
    out, n = [0] * 128, 0
    for c in range(128):
        if re.match(f"[{chars}]", chr(c)):
            out[c] = (n // COUNTS_PER_LONG << 6) + n % COUNTS_PER_LONG * COUNT_BITS
            n += 1
    return out


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _count_of(counts: Column, code: Column) -> Column:
    shifted = F.call_function("shiftright", F.get(counts, F.shiftright(code, 6)), code.bitwiseAND(63))
    return shifted.bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")


def _one_at(code: Column, place: Column) -> Column:
    """One, shifted to where the count lies, for the long that holds it; else 0."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(63))
    return F.when(F.shiftright(code, 6) == place, one).otherwise(F.lit(0).cast("long"))


def block_stretches(part: Column, chars: str, window: int, threshold: float) -> Column:
    """Array of (from, to): places of the first and last window of each stretch of
    windows at or above the threshold, in a string of the class's characters.

    The counts of a window and its sum of n log2 n over them go along."""
    places = _codes(chars)
    n_longs = max(places) // 64 + 1
    weight = [0.0, *(n * math.log2(n) for n in range(1, window + 2))]
    #: What the n-th of a character adds to the sum.
    gains = _literals([0.0, *(weight[n] - weight[n - 1] for n in range(1, window + 2))])
    least_sum = (math.log2(window) - threshold) * window
    codes = F.transform(
        F.slice(F.split(part, ""), F.lit(1), F.length(part)),
        lambda c: F.get(_literals(places), F.ascii(c)),
    )

    def entered(acc: Column, code: Column) -> Column:
        return F.struct(
            F.transform(acc["counts"], lambda x, j: x + _one_at(code, j)).alias("counts"),
            (acc["sum"] + F.get(gains, _count_of(acc["counts"], code) + 1)).alias("sum"),
        )

    def moved(acc: Column, gone: Column, come: Column) -> Column:
        """The next window's; the two characters differ."""
        less = F.get(gains, _count_of(acc["counts"], gone))
        more = F.get(gains, _count_of(acc["counts"], come) + 1)
        change = lambda x, j: x - _one_at(gone, j) + _one_at(come, j)
        return F.struct(
            F.transform(acc["counts"], change).alias("counts"), (acc["sum"] - less + more).alias("sum")
        )

    def walk(codes: Column) -> Column:
        last = F.size(codes) - window

        def slide(bag: Column, i: Column) -> Column:
            gone, come = F.get(codes, i - 1), F.get(codes, i + window - 1)
            return F.when((i == 0) | (gone == come), bag).otherwise(moved(bag, gone, come))

        def move(acc: Column, i: Column) -> Column:
            closed = F.struct(acc["begin"].alias("from"), (i - 1).alias("to"))

            def judged(bag: Column) -> Column:
                hot = bag["sum"] <= least_sum
                return F.struct(
                    bag.alias("bag"),
                    hot.alias("hot"),
                    F.when(hot & ~acc["hot"], i).otherwise(acc["begin"]).alias("begin"),
                    F.when(~hot & acc["hot"], F.array_append(acc["spans"], closed))
                    .otherwise(acc["spans"])
                    .alias("spans"),
                )

            return _let(slide(acc["bag"], i), judged)

        def finish(acc: Column) -> Column:
            closed = F.struct(acc["begin"].alias("from"), last.alias("to"))
            return F.when(acc["hot"], F.array_append(acc["spans"], closed)).otherwise(acc["spans"])

        empty = F.struct(
            F.array_repeat(F.lit(0).cast("long"), n_longs).alias("counts"), F.lit(0.0).alias("sum")
        )
        zero = F.struct(
            F.aggregate(F.slice(codes, 1, window), empty, entered).alias("bag"),
            F.lit(False).alias("hot"),
            F.lit(0).alias("begin"),
            F.array().cast(STRETCHES).alias("spans"),
        )
        return F.aggregate(F.sequence(F.lit(0), last), zero, move, finish)

    return F.when(F.length(part) >= window, _let(codes, walk)).otherwise(F.array().cast(STRETCHES))


def hot_stretches(run: Column, chars: str, window: int, threshold: float) -> Column:
    """The stretches of a whole run: those of its blocks, where one that goes on in the
    next block is one stretch.  A block takes the characters of its last window along."""
    last_block = F.shiftright(F.greatest(F.length(run) - window, F.lit(0)), BLOCK_BITS)

    def of_block(b: Column) -> Column:
        part = F.substring(run, b * BLOCK + 1, F.lit(BLOCK + window - 1))
        return F.transform(
            block_stretches(part, chars, window, threshold),
            lambda s: F.struct((s["from"] + b * BLOCK).alias("from"), (s["to"] + b * BLOCK).alias("to")),
        )

    def joined(found: Column) -> Column:
        begins = F.filter(found, lambda s, i: ~(F.get(found, i - 1)["to"] + 1).eqNullSafe(s["from"]))
        ends = F.filter(found, lambda s, i: ~(F.get(found, i + 1)["from"] - 1).eqNullSafe(s["to"]))
        return F.zip_with(
            begins, ends, lambda b, e: F.struct(b["from"].alias("from"), e["to"].alias("to"))
        )

    return _let(F.flatten(F.transform(F.sequence(F.lit(0), last_block), of_block)), joined)


def candidate_pattern(chars: str, shortest: int) -> str:
    """Whole runs of the class with a letter."""
    no_letter = chars.replace("A-Za-z", "").replace("A-Fa-f", "")
    return f"(?<![{chars}])(?=[{no_letter}]*+[A-Za-z])[{chars}]{{{shortest},}}+"


def without_allowed(text: Column, chars: str, shortest: int) -> Column:
    """The text, of the same length, with blanks for the parts of long runs that hold an
    allowed word.  A match starts with such a part or goes on where the last one ended;
    runs that are UUIDs are blanked before, so that none is cut."""
    part = f"[[{chars}]&&[^{BREAKS}]]"
    run = f"(?<![{chars}])(?=[{chars}]{{{shortest}}})[{chars}]*?(?:{ALLOWED_WORD})"
    begins = f"(?<!{part})(?={part}*?(?:{ALLOWED_WORD}))"
    whole = F.regexp_replace(text, f"(?<![{chars}]){UUID}(?![{chars}])", " " * 36)
    blanked = F.regexp_replace(whole, f"(?:\\G(?!\\A)|{begins}){part}", " ")
    return F.when(text.rlike(run), blanked).otherwise(text)


def entropy_spans(text: Column, kind: str, chars: str, shortest: int, window: int, least: float) -> Column:
    pattern = candidate_pattern(chars, shortest)

    def spans(text: Column) -> Column:
        return F.transform(
            F.filter(_placed(text, pattern), lambda p: ~p["match"].rlike(f"^{UUID}$")),
            lambda p: F.transform(
                hot_stretches(p["match"], chars, window, least),
                lambda s: _span(kind, p.start + s["from"], p.start + s["to"] + window),
            ),
        )

    found = F.flatten(_let(without_allowed(text, chars, shortest), spans))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NONE))


# --- whole texts ------------------------------------------------------------------------


def secret_spans(text: Column) -> Column:
    """Array of (start, kind, end), sorted; ``KINDS`` names the kinds."""
    text = F.coalesce(text, F.lit(""))
    found = [base_spans(text, *b) for b in BASE] + [entropy_spans(text, *c) for c in CLASSES]
    return F.array_sort(F.flatten(F.array(*found)))


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with what the spans cover replaced; touching spans give one mark."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s.start),
            F.array_append(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.struct(
                    F.element_at(acc, -1)["start"].alias("start"),
                    F.greatest(F.element_at(acc, -1)["end"], s.end).alias("end"),
                ),
            ),
        ).otherwise(F.array_append(acc, F.struct(s.start.alias("start"), s.end.alias("end")))),
    )
    text = F.coalesce(text, F.lit(""))
    kept = F.transform(
        merged,
        lambda m, i: F.concat(
            F.substring(
                text,
                (F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                (m.start - F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))).cast("int"),
            ),
            F.lit(mark),
        ),
    )
    tail = F.substring(
        text, (F.coalesce(F.get(merged, F.size(merged) - 1)["end"], F.lit(0)) + 1).cast("int"), F.length(text)
    )
    return F.concat(F.array_join(kept, ""), tail)
