r"""Repair of conversation structure by iterative-deepening A*.

The rows of a conversation, by turn (null first), role and text, are edited so that the
first letters of the roles read ``(s?(ua)+)?``.  Edits and their costs: Delete 3, Insert an
empty turn of user or assistant 2, Keep 0, Rerole to user or assistant 2; a blank or
repeated row must be deleted, a truncated one that stays costs 1 more.  Of the cheapest
repairs the one whose edits read first in ASCII order (D, I, K, R) is taken.

The pattern is an automaton of four states, and in each there is one role that can be
inserted or given, so the edits alone fix the result.  The search goes depth-first in the
order of the edits under a bound that grows from the least possible cost to the least
cost that exceeded it; a table of failed states (place, state, what was left to spend)
ends branches that failed before.  The first accepting path is the answer.

A conversation of more than ``SEGMENT`` rows is never gathered: its rows are numbered over
ranges and cut into segments.  Each segment's least costs between states, chained from
the end, say what every state costs from there on; each segment is then searched from
every state, the cost of the rest added to its end, and the true entries are followed
from the start.  The result is that of one search over the whole, and the work is linear
in the rows.

* A null role or text is one space: no role, and a blank text.  An empty text is blank.
  Texts of any length are looked at in whole, in the JVM; the search sees one letter a row.
* Rows that repeat in a conversation are duplicates but for the first; ties of a turn go
  by role, then text.  Rows of a null conv_id form one conversation.
* An empty table gives empty results.  Columns other than the four are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import checked_broadcast, numbered, written
from veilframe.operators.entities import lookup

#: Most rows searched in one go.
SEGMENT = 64

NEVER = 1 << 40
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = (2, 2, 3, 2)  # the state after the one role that may be inserted or given
ROLE_OF = {2: "user", 3: "assistant"}
ACCEPTED = (0, NEVER, NEVER, 0)
#: What states cost at the end, inserts included.
CLOSED = (0, 2 * INSERT, INSERT, 0)

#: States that can be the last, from each.
REACHED = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
LEGAL = ("su", "ua", "au")

#: Least cost of an edit at one of two neighbours or between them, above their own least.
PAIR = 2

#: Least cost of a row, by its letter: d must go, x has another role; capitals are truncated.
LEAST = {"d": DELETE, "x": REROLE, "X": DELETE, "s": 0, "u": 0, "a": 0, "S": 1, "U": 1, "A": 1}

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*+\z"


# --- one search -----------------------------------------------------------------------


def moves(letters: str, place: int, state: int, final: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, next place, next state) in ASCII order."""
    inside = place < len(letters)
    if inside:
        yield "D", DELETE, place + 1, state
    if inside or final:
        yield "I", INSERT, place, GIVEN[state]
    if inside and letters[place] != "d":
        letter = letters[place].lower()
        more = 0 if letter == letters[place] else TRUNCATED
        if (state, letter) in KEPT:
            yield "K", more, place + 1, KEPT[state, letter]
        yield "R", REROLE + more, place + 1, GIVEN[state]


def rest_costs(letters: str) -> list[int]:
    """What the rows from each place on cost at least: each row its least, and each of
    the disjoint pairs of neighbours that cannot both stay as they are an edit."""
    n = len(letters)
    rows, pairs = [0] * (n + 1), [0] * (n + 1)
    after = n  # the next row that may stay
    for i in range(n - 1, -1, -1):
        rows[i] = rows[i + 1] + LEAST[letters[i]]
        pairs[i] = pairs[i + 1]
        if letters[i] != "d":
            pair = letters[i : i + 1].lower() + letters[after : after + 1].lower()
            if len(pair) == 2 and "x" not in pair and pair not in LEGAL:
                pairs[i] = max(pairs[i], PAIR + pairs[after + 1])
            after = i
    return [a + b for a, b in zip(rows, pairs)]


@lru_cache(maxsize=20_000)
def search(
    letters: str, entry: int = 0, after: tuple[int, ...] = ACCEPTED, final: bool = True
) -> tuple[int, str, int] | None:
    """Cost with what comes after, edits and last state of the cheapest repair; of equal
    ones the first in ASCII order.  ``after`` is what each last state costs."""
    rest = rest_costs(letters)
    ends = [min(after[e] for e in REACHED[state]) for state in range(4)]
    bound, failed = rest[0] + ends[entry], {}
    while bound < NEVER:
        beyond = NEVER
        path: list[str] = []
        # place, state, spent, moves not tried yet
        stack = [(0, entry, 0, moves(letters, 0, entry, final))]
        while stack:
            place, state, spent, todo = stack[-1]
            if place == len(letters) and spent + after[state] <= bound:
                return spent + after[state], "".join(path), state
            for edit, cost, new_place, new_state in todo:
                total = spent + cost
                least = total + rest[new_place] + ends[new_state]
                if least > bound:
                    beyond = min(beyond, least)
                elif failed.get((new_place, new_state), -1) < bound - total:
                    path.append(edit)
                    stack.append((new_place, new_state, total, moves(letters, new_place, new_state, final)))
                    break
            else:
                if place == len(letters):
                    beyond = min(beyond, spent + after[state])
                failed[place, state] = max(failed.get((place, state), -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond
    return None


def steps(letters: str, audit: str, entry: int = 0) -> list[dict]:
    """The edits with the row they take and the role they give."""
    place, state, out = 0, entry, []
    for edit in audit:
        if edit in "IR":
            state = GIVEN[state]
        elif edit == "K":
            state = KEPT[state, letters[place].lower()]
        role = ROLE_OF[state] if edit in "IR" else None
        out.append({"edit": edit, "row": None if edit == "I" else place, "role": role})
        place += edit != "I"
    return out


STEP = "struct<edit:string,row:int,role:string>"


def repairs(letters: Column) -> Column:
    """cost, audit and steps of whole conversations."""

    @F.pandas_udf(f"cost long, audit string, steps array<{STEP}>")
    def found(texts: pd.Series) -> pd.DataFrame:
        best = [search(t) for t in texts]
        return pd.DataFrame(
            [(cost, audit, steps(t, audit)) for t, (cost, audit, _) in zip(texts, best)],
            columns=["cost", "audit", "steps"],
        )

    return found(letters)


# --- rows -------------------------------------------------------------------------------


def fault(text: Column, seen: Column) -> Column:
    """Name of a row's first fault, null for none."""
    return (
        F.when(~text.rlike(NOT_BLANK), "blank")
        .when(seen, "duplicate")
        .when(~text.rlike(ENDED), "truncated")
    )


def letter(role: Column, fault: Column) -> Column:
    first = F.when(role.rlike("^[sua]"), F.substring(role, 1, 1)).otherwise("x")
    return (
        F.when(fault.isin("blank", "duplicate"), "d")
        .when(fault == "truncated", F.upper(first))
        .otherwise(first)
    )


def is_legal(before: Column, role: Column) -> Column:
    return F.concat(F.substring(before, 1, 1), F.substring(role, 1, 1)).isin(*LEGAL)


def repaired_rows(said: Column, done: Column) -> Column:
    """Role and text of the rows that the steps leave."""
    return F.transform(
        F.filter(done, lambda s: s.edit != "D"),
        lambda s: F.struct(
            F.coalesce(s.role, F.get(said, s.row).role).alias("role"),
            F.when(s.edit == "I", "").otherwise(F.get(said, s.row).text).alias("text"),
        ),
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment (from 0), the ``COUNTS`` (longs, those of a segment; gaps and cost
    at segment 0 only, for the whole conversation), audit, repaired (array of role, text).

    A conversation of at most ``segment`` rows is one row; others have a row a segment."""
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    sizes = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > segment)
    sizes = written(sizes.select(F.col("conv_id").alias("long_id")), "long-conversations")
    if sizes.isEmpty():
        return short_repairs(said)
    many = checked_broadcast(sizes)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = short_repairs(said.join(many, same, "left_anti"))
    return short.unionByName(long_repairs(said.join(many, same, "left_semi"), segment))


def short_repairs(said: DataFrame) -> DataFrame:
    whole = said.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said")
    )

    def judged(t: Column, i: Column) -> Column:
        seen = F.exists(
            F.slice("said", F.lit(1), i), lambda e: (e.role == t.role) & (e.text == t.text)
        )
        return F.struct(t.turn.alias("turn"), t.role.alias("role"), t.text.alias("text"),
                        fault(t.text, seen).alias("fault"))

    rows = whole.select("conv_id", F.transform("said", judged).alias("said"))
    letters = F.array_join(F.transform("said", lambda t: letter(t.role, t.fault)), "")
    known = F.array_distinct(F.filter(F.transform("said", lambda t: t.turn), lambda t: t.isNotNull()))
    illegal = F.filter(
        F.transform(
            "said", lambda t, i: (i > 0) & ~is_legal(F.get(F.col("said"), i - 1).role, t.role)
        ),
        lambda bad: bad,
    )
    counts = [
        F.size(F.filter("said", lambda t: t.fault == name)).cast("long").alias(name)  # noqa: B023
        for name in ("blank", "duplicate", "truncated")
    ]
    found = rows.select(
        "conv_id", "said",
        F.coalesce(F.array_max(known) - F.array_min(known) + 1 - F.size(known), F.lit(0)).cast("long").alias("gaps"),
        *counts, F.size(illegal).cast("long").alias("illegal"), repairs(letters).alias("r"),
    )
    return found.select(
        "conv_id", F.lit(0).cast("long").alias("segment"), *COUNTS[:-1], F.col("r.cost").alias("cost"),
        F.col("r.audit").alias("audit"), repaired_rows(F.col("said"), F.col("r.steps")).alias("repaired"),
    )


# --- long conversations -----------------------------------------------------------------


def least_costs(letters: Column) -> Column:
    """Least cost from each state to each, -1 where there is no way."""

    @F.pandas_udf("array<long>")
    def costs(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[int]:
            ways = [
                search(text, i, tuple(0 if k == j else NEVER for k in range(4)), False)
                for i in range(4)
                for j in range(4)
            ]
            return [-1 if w is None else w[0] for w in ways]

        return pd.Series([one(t) for t in texts])

    return costs(letters)


def costs_after(costs: Column) -> Column:
    """For each segment's costs, in order, what its last states cost from there on."""

    @F.pandas_udf("array<array<long>>")
    def chained(rows: pd.Series) -> pd.Series:
        def one(segments) -> list[list[int]]:
            after = [list(CLOSED)]
            for c in reversed(segments[1:]):
                ways = [[c[4 * i + j] + after[-1][j] if c[4 * i + j] >= 0 else NEVER for j in range(4)] for i in range(4)]
                after.append([min(w) for w in ways])
            return after[::-1]

        return pd.Series([one([list(map(int, c)) for c in row]) for row in rows])

    return chained(costs)


WAY = f"struct<cost:long,audit:string,last:int,steps:array<{STEP}>>"


def ways(letters: Column, after: Column, final: Column) -> Column:
    """The cheapest way through a segment from each state."""

    @F.pandas_udf(f"array<{WAY}>")
    def found(texts: pd.Series, afters: pd.Series, finals: pd.Series) -> pd.Series:
        out = []
        for text, after, last in zip(texts, afters, finals):
            ends = ACCEPTED if last else tuple(map(int, after))
            row = []
            for entry in range(4):
                way = search(text, entry, ends, bool(last))
                row.append(way and {"cost": way[0], "audit": way[1], "last": way[2], "steps": steps(text, way[1], entry)})
            out.append(row)
        return pd.Series(out)

    return found(letters, after, final)


def followed(lasts: Column) -> Column:
    """The state in which each segment is entered; ``lasts`` are arrays of the last state
    for each entry, in order."""
    return F.aggregate(
        lasts,
        F.array(F.lit(0)),
        lambda acc, states: F.array_append(acc, F.get(states, F.element_at(acc, -1))),
    )


def long_repairs(said: DataFrame, segment: int) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = written(numbered(said, order, "at"), "long-turns")
    # Counts of a conversation: one row each, and few are long.
    own = written(
        rows.groupBy(F.col("conv_id").alias("own_id")).agg(
            F.min("at").alias("first"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        ),
        "long-counts",
    )
    same = F.col("conv_id").eqNullSafe(F.col("own_id"))
    key = F.md5(F.to_json(F.struct("conv_id", "role", "text")).cast("binary"))
    placed = written(
        rows.join(checked_broadcast(own.select("own_id", "first")), same)
        .select("conv_id", (F.col("at") - F.col("first")).alias("place"), "role", "text", key.alias("key")),
        "long-places",
    )
    firsts = placed.groupBy("key").agg(F.min("place").alias("first_place"))
    judged = lookup(placed, firsts, "key").select(
        "conv_id", "place", "role", "text",
        fault(F.col("text"), F.col("place") > F.col("first_place")).alias("fault"),
    )
    cut = judged.groupBy("conv_id", F.floor(F.col("place") / segment).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "fault"))).alias("said"),
        *[F.count(F.when(F.col("fault") == n, 1)).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    letters = F.array_join(F.transform("said", lambda t: letter(t.role, t.fault)), "")
    inner = F.size(
        F.filter(
            F.transform("said", lambda t, i: (i > 0) & ~is_legal(F.get(F.col("said"), i - 1).role, t.role)),
            lambda bad: bad,
        )
    )
    parts = written(
        cut.withColumn("letters", letters)
        .withColumn("inner", inner)
        .withColumn("head", F.get("said", F.lit(0)).role)
        .withColumn("tail", F.element_at("said", -1).role)
        .withColumn("costs", least_costs(F.col("letters"))),
        "segments",
    )
    # From here on a segment is a short row.
    line = Window.partitionBy("conv_id").orderBy("segment")
    slim = parts.select("conv_id", "segment", "costs", "head", "tail").withColumn(
        "broken", (F.lag("tail").over(line).isNotNull() & ~is_legal(F.lag("tail").over(line), F.col("head"))).cast("int")
    )
    lists = slim.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "costs", "broken"))).alias("all")
    )
    ahead = lists.withColumn("after", costs_after(F.col("all")["costs"])).select(
        F.col("conv_id").alias("own_id"),
        F.inline(
            F.transform(
                "all",
                lambda s, i: F.struct(
                    s.segment.alias("own_segment"),
                    F.get(F.col("after"), i).alias("after"),
                    (i == F.size("all") - 1).alias("final"),
                    s.broken.alias("broken"),
                ),
            )
        ),
    )
    same = same & (F.col("segment") == F.col("own_segment"))
    searched = written(
        parts.drop("costs")
        .join(ahead, same)
        .drop("own_id", "own_segment")
        .withColumn("ways", ways(F.col("letters"), F.col("after"), F.col("final"))),
        "ways",
    )
    entered = (
        searched.groupBy(F.col("conv_id").alias("own_id"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct("segment", F.col("ways")["last"].alias("last")))
            ).alias("all")
        )
        .withColumn("states", followed(F.col("all")["last"]))
        .select("own_id", F.inline(F.transform("all", lambda s, i: F.struct(
            s.segment.alias("own_segment"), F.get(F.col("states"), i).alias("entry")))))
    )
    at_start = lambda value: F.when(F.col("segment") == 0, value).otherwise(0).cast("long")
    return (
        searched.join(entered, same)
        .drop("own_id", "own_segment")
        .withColumn("way", F.get("ways", F.col("entry")))
        .join(checked_broadcast(own.select("own_id", "gaps")), F.col("conv_id").eqNullSafe(F.col("own_id")))
        .select(
            "conv_id", "segment", at_start(F.col("gaps")).alias("gaps"), "blank", "duplicate", "truncated",
            (F.col("inner") + F.col("broken")).cast("long").alias("illegal"),
            at_start(F.col("way.cost")).alias("cost"), F.col("way.audit").alias("audit"),
            repaired_rows(F.col("said"), F.col("way.steps")).alias("repaired"),
        )
    )


def reports(segments: DataFrame) -> DataFrame:
    """One row a conversation: its counts, audit, and the repaired ``role:text`` lines as
    one text.  Most conversations are one row already; the text of a long one is put
    together in one row."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n")
    told = segments.withColumn("lines", F.when(F.size("repaired") > 0, lines))
    parts = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    texts = F.filter(F.transform("parts", lambda p: p["lines"]), lambda t: t.isNotNull())
    return (
        told.groupBy("conv_id")
        .agg(
            *[F.sum(c).alias(c) for c in COUNTS],
            F.sort_array(F.collect_list(F.struct("segment", "audit", "lines"))).alias("parts"),
        )
        .select("conv_id", *COUNTS, parts("audit").alias("audit"), F.array_join(texts, "\n").alias("lines"))
    )
