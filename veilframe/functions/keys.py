"""Normalised keys: surface forms with one key are one entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let
from veilframe.functions.text import strip
from veilframe.operators.rules import NAME_KEY_PARTICLES


def name_key(value: Column) -> Column:
    """Upper-cased words without particles, in sorted order."""
    words = F.filter(
        F.split(F.upper(value), r"(?U)\s+"),
        lambda w: (w != "") & ~w.isin(list(NAME_KEY_PARTICLES)),
    )
    return F.array_join(F.array_sort(words), "|")


def phone_key(value: Column) -> Column:
    """Digits and plus signs; 00 and a Belgian leading 0 become a country code."""
    return let(
        F.regexp_replace(value, r"(?U)[^\d+]", ""),
        lambda d: F.when(F.startswith(d, F.lit("00")), F.concat(F.lit("+"), F.substr(d, F.lit(3))))
        .when(
            F.startswith(d, F.lit("0")) & (F.length(d) == 10),
            F.concat(F.lit("+32"), F.substr(d, F.lit(2))),
        )
        .otherwise(d),
    )


def iban_key(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), r"(?U)\s", "")


def entity_key(value: Column, category: Column) -> Column:
    return (
        F.when(category == "PERSON", name_key(value))
        .when(category == "PHONE", phone_key(value))
        .when(category == "IBAN", iban_key(value))
        .otherwise(strip(F.upper(value)))
    )


def placeholder(category: Column, number: Column) -> Column:
    """``CATEGORY_007``; wider numbers keep all their digits."""
    return F.concat(category, F.format_string("_%03d", number))


def placeholder_category(value: Column) -> Column:
    """Everything before the last underscore."""
    return F.regexp_extract(value, r"^([\s\S]*)_", 1)


def placeholder_number(value: Column) -> Column:
    return F.substring_index(value, "_", -1).cast("long")
