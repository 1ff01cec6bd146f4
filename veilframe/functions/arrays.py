"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Columns are expressions: naming one twice computes it twice, and naming it
    inside a lambda computes it per element.  The last step of a fold over nothing,
    which begins with the value, binds it to a lambda variable instead.  (A
    ``transform`` would copy what the body gives, with all strings in it.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def strings(values: Sequence[str]) -> Column:
    """Constant array of strings."""
    return F.array(*[F.lit(v) for v in values])


def explode_structs(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per struct in an array column, fields as columns.

    ``inline_outer`` plus a filter on the generated rows: with the inner form
    the optimizer infers a ``size(array) > 0`` filter and pushes it below the
    projection, which would compute the array a second time.
    """
    rows = df.select(*keys, F.inline_outer(column))
    first = [c for c in rows.columns if c not in keys][0]
    return rows.where(F.col(first).isNotNull())


# Items folded in one go: long arrays are folded by steps, so that copying the growing
# result does not cost the square of their length.
STEP = 128


def running(
    values: Column, zero: Column, merge: Callable[[Column, Column], Column]
) -> Column:
    """For each value the fold of it and all before it."""

    def folds(items: Column, start: Column) -> Column:
        return F.aggregate(
            items,
            F.array(start),
            lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)),
        )

    def all_steps(steps: Column) -> Column:
        totals = F.transform(steps, lambda s: F.aggregate(s, zero, merge))
        return let(
            F.aggregate(
                totals,
                F.array(zero),
                lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)),
            ),
            lambda starts: F.flatten(
                F.transform(
                    steps, lambda s, i: F.slice(folds(s, F.get(starts, i)), 2, F.size(s))
                )
            ),
        )

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / STEP).cast("int")
        steps = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(v, i * STEP + 1, F.lit(STEP))
        )
        return F.when(F.size(v) == 0, F.slice(F.array(zero), 1, 0)).otherwise(let(steps, all_steps))

    return let(values, cut)


def runs(ordered: Column, starts_run: Callable[[Column, Column], Column]) -> Column:
    """An array cut into arrays: a run starts at each item (but the first) for which
    ``starts_run(items, place)`` holds.  No run is empty."""

    def cut(items: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | starts_run(items, i)
        )
        return let(
            first,
            lambda places: F.transform(
                places,
                lambda p, j: F.slice(
                    items, p + 1, F.coalesce(F.get(places, j + 1), F.size(items)) - p
                ),
            ),
        )

    def or_none(items: Column) -> Column:
        return F.when(F.size(items) > 0, cut(items)).otherwise(F.slice(F.array(items), 1, 0))

    return let(ordered, or_none)
