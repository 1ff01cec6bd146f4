"""Anonymisation strategies: column functions of a value and its category.

A strategy is ``fn(value, category) -> Column``.  ``register_strategy`` adds
one, a pandas UDF included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let

StrategyFn = Callable[[Column, Column], Column]


def redact(marker: str = "[REDACTED]", include_category: bool = True) -> StrategyFn:
    def apply(value: Column, category: Column) -> Column:
        if include_category:
            return F.concat(F.lit("["), category, F.lit("]"))
        return F.lit(marker)

    return apply


def _stars(char: str, n: Column) -> Column:
    return F.repeat(F.lit(char), n)


def mask_words(value: Column, char: str = "*", keep_start: int = 1, keep_end: int = 2) -> Column:
    """Mask every word, keeping characters at its ends; one blank between words."""

    def one(w: Column) -> Column:
        hidden = F.length(w) - (keep_start + keep_end)
        return F.when(hidden <= 0, _stars(char, F.length(w))).otherwise(
            F.concat(
                F.substring(w, 1, keep_start),
                _stars(char, hidden),
                F.right(w, F.lit(keep_end)) if keep_end > 0 else F.lit(""),
            )
        )

    words = F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, one), " ")


def mask_email(value: Column, char: str = "*", keep_start: int = 1, keep_end: int = 2) -> Column:
    """First character of the local part and of the domain, and the top level."""

    def head(part: Column) -> Column:
        return F.concat(F.substring(part, 1, 1), _stars(char, F.length(part) - 1))

    domain = F.substring_index(value, "@", -1)
    local = F.substr(value, F.lit(1), F.length(value) - F.length(domain) - 1)
    top = F.substring_index(domain, ".", -1)
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    masked_domain = F.when(
        F.contains(domain, F.lit(".")), F.concat(head(name), F.lit("."), top)
    ).otherwise(_stars(char, F.length(domain)))
    return F.when(
        F.contains(value, F.lit("@")), F.concat(head(local), F.lit("@"), masked_domain)
    ).otherwise(mask_words(value, char, keep_start, keep_end))


def mask_phone(value: Column, char: str = "*") -> Column:
    """First and last two digits stay; the layout stays."""

    def one(digits: Column) -> Column:
        chars = F.split(value, "")
        # Characters of the value paired with the digits seen up to each one.
        state = F.struct(F.lit(0).alias("seen"), F.lit("").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            is_digit = c.rlike(r"(?U)^\d$")
            hide = is_digit & (acc["seen"] >= 2) & (acc["seen"] < digits - 2)
            return F.struct(
                (acc["seen"] + is_digit.cast("int")).alias("seen"),
                F.concat(acc["out"], F.when(hide, F.lit(char)).otherwise(c)).alias("out"),
            )

        return F.when(digits <= 4, _stars(char, F.length(value))).otherwise(
            F.aggregate(chars, state, step, lambda acc: acc["out"])
        )

    return let(F.length(F.regexp_replace(value, r"(?U)\D", "")), one)


def mask_iban(value: Column, char: str = "*") -> Column:
    """First and last four characters stay; blanks every four if there were any."""

    def one(clean: Column) -> Column:
        masked = F.concat(
            F.substring(clean, 1, 4),
            _stars(char, F.length(clean) - 8),
            F.right(clean, F.lit(4)),
        )
        grouped = F.regexp_replace(masked, r"([\s\S]{4})(?=[\s\S])", "$1 ")
        return (
            F.when(F.length(clean) < 8, _stars(char, F.length(value)))
            .when(F.contains(value, F.lit(" ")), grouped)
            .otherwise(masked)
        )

    return let(F.replace(value, F.lit(" "), F.lit("")), one)


def mask(char: str = "*", keep_start: int = 1, keep_end: int = 2) -> StrategyFn:
    def apply(value: Column, category: Column) -> Column:
        return (
            F.when(category == "EMAIL", mask_email(value, char, keep_start, keep_end))
            .when(category == "PHONE", mask_phone(value, char))
            .when(category == "IBAN", mask_iban(value, char))
            .otherwise(mask_words(value, char, keep_start, keep_end))
        )

    return apply


def hash_value(algorithm: str = "sha256", truncate: int | None = 16, salt: str = "") -> StrategyFn:
    """Hex digest of salt, value and category; unknown algorithms mean sha256."""

    def apply(value: Column, category: Column) -> Column:
        salted = F.concat(F.lit(salt or ""), value, category)
        if algorithm == "sha512":
            digest = F.sha2(salted, 512)
        elif algorithm == "md5":
            digest = F.md5(salted)
        else:
            digest = F.sha2(salted, 256)
        return F.substring(digest, 1, truncate) if truncate else digest

    return apply


def encrypt(key: bytes | str | Column | None = None) -> StrategyFn:
    """Reversible AES-GCM, base64.  The caller supplies and keeps the key: a key
    made up here would be lost with the job and the values with it."""
    if key is None:
        raise ValueError("the encrypt strategy needs key= (16, 24 or 32 bytes)")

    def apply(value: Column, category: Column) -> Column:
        return F.base64(F.aes_encrypt(value.cast("binary"), _key(key), F.lit("GCM")))

    return apply


def decrypt(token: Column, key: bytes | str | Column) -> Column:
    return F.aes_decrypt(F.unbase64(token), _key(key), F.lit("GCM")).cast("string")


def _key(key: bytes | str | Column) -> Column:
    if isinstance(key, Column):
        return key
    return F.lit(key.encode() if isinstance(key, str) else key)


@dataclass(frozen=True)
class Strategy:
    name: str
    make: Callable[..., StrategyFn] | None  # None: placeholders from the mapping
    reversible: bool = False


STRATEGIES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("replace", None, reversible=True),
        Strategy("redact", redact),
        Strategy("mask", mask),
        Strategy("hash", hash_value),
        Strategy("encrypt", encrypt, reversible=True),
    )
}


def register_strategy(name: str, make: Callable[..., StrategyFn], reversible: bool = False) -> None:
    """Add a strategy: ``make(**options)`` returns ``fn(value, category)``."""
    STRATEGIES[name] = Strategy(name, make, reversible)


def get_strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {name}. Available: {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def strategy_fn(name: str, **options) -> StrategyFn | None:
    """Column function of a strategy; None for ``replace``."""
    strategy = get_strategy(name)
    return None if strategy.make is None else strategy.make(**options)


def can_deanonymize(name: str) -> bool:
    return get_strategy(name).reversible
