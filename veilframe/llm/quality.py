"""Quality rules as a short-circuit cascade.

What the rules look at (words, lines, counts) is timed on a sample, apart from the rules,
as several rules share it.  The next rule is always the one with the most rejections, among
the sample's texts that the rules before it let pass, per second of the work that is not
done yet; a document stops at the first rule that rejects it.  The order decides only how
much work is done: a document is kept when no rule rejects it, whatever the sample was.

Words are runs of anything but ASCII blanks, lines end at line feeds, characters are
code points.  A null text is empty; an empty text is rejected for its few words.
Rows are judged one by one, so repeated rows get equal verdicts; rules that tie go by
their cost, then by their place in ``RULES``; an empty table gives an empty result.  The verdict is one struct column, which no input column can clash
with unless it has the name chosen for it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
NO_LETTERS = bytes(b for b in range(256) if b not in LETTERS and b not in BLANKS)
WINDOW = 5

SAMPLE_ROWS = 1000
SAMPLE_SEED = 11
#: Each feature's time is the median of so many.
PASSES = 3


class Text:
    """What the rules look at, each computed when first asked for."""

    def __init__(self, text: bytes | None) -> None:
        self.raw = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # at the ASCII blanks

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, BLANKS + CONTINUED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, CAPITALS))

    @cached_property
    def lettered_words(self) -> int:
        """Words with a letter; what is beyond ASCII counts as letters."""
        return len(self.raw.translate(None, NO_LETTERS).split())

    @cached_property
    def n_doubled(self) -> int:
        """Words equal to the word before."""
        return sum(map(eq, self.words, self.words[1:]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of five that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, end = 0, 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                covered += i + WINDOW - max(i, end)
                end = i + WINDOW
        return covered


def base_failed(t: Text) -> bool:
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


#: Each says whether it rejects; thresholds are in whole numbers.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "doubled_words": lambda t: 10 * t.n_doubled > 3 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 12 * t.n_words,
    "capitals": lambda t: 2 * t.n_capitals > t.word_chars,
    "letterless_words": lambda t: 2 * t.lettered_words < t.n_words,
}


#: What each feature is made of, parts first, and what each rule looks at.
PARTS: dict[str, tuple[str, ...]] = {
    "words": (),
    "lines": (),
    "n_words": ("words",),
    "word_chars": (),
    "n_symbols": (),
    "n_capitals": (),
    "lettered_words": (),
    "n_doubled": ("words",),
    "n_dup_lines": ("lines",),
    "n_repeat_words": ("words",),
}
LOOKS_AT: dict[str, tuple[str, ...]] = {
    "few_words": ("n_words",),
    "repeated_windows": ("n_repeat_words", "n_words"),
    "doubled_words": ("n_doubled", "n_words"),
    "repeated_lines": ("n_dup_lines", "lines"),
    "symbols": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "letterless_words": ("lettered_words", "n_words"),
}


def rejected_by(t: Text, order: list[str]) -> str | None:
    return next((name for name in order if RULES[name](t)), None)


def needed(rule: str) -> set[str]:
    """Features a rule looks at, and their parts."""
    own = set(LOOKS_AT[rule])
    return own | {part for feature in own for part in PARTS[feature]}


def feature_seconds(texts: list[bytes | None], passes: int = PASSES) -> np.ndarray:
    """Seconds by text and feature, in the order of ``PARTS``; a feature's parts are there
    when it is timed."""
    seconds = np.zeros((passes, len(texts), len(PARTS)))
    for run in seconds:
        for row, text in zip(run, texts):
            t = Text(text)
            for i, feature in enumerate(PARTS):
                begin = time.perf_counter()
                getattr(t, feature)
                row[i] = time.perf_counter() - begin
    return np.median(seconds, axis=0)


def greedy_order(rejects: np.ndarray, seconds: np.ndarray) -> list[tuple[str, int, int, float]]:
    """rule, texts it sees, rejections among them, seconds of its work, in the order in
    which the rules run.  ``rejects`` is by text and rule, ``seconds`` by text and feature."""
    names, features = list(RULES), list(PARTS)
    alive, done, out = np.ones(len(rejects), dtype=bool), set(), []
    while len(out) < len(names):
        taken = {name for name, *_ in out}
        choices = []
        for r, name in enumerate(names):
            if name not in taken:
                todo = [features.index(f) for f in needed(name) - done]
                cost = float(seconds[alive][:, todo].sum()) + 1e-9 * (1 + alive.sum())
                hits = int(rejects[alive, r].sum())
                choices.append((-hits / cost, cost, r, hits))
        _, cost, r, hits = min(choices)
        out.append((names[r], int(alive.sum()), hits, cost))
        alive &= ~rejects[:, r]
        done |= needed(names[r])
    return out


def profile(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """place, rule, n, rejected, seconds of each rule in the order chosen, on ``rows`` rows
    (all, if fewer) from all parts of the table: of a seeded sample of twice as many, those
    of the least hashes, so that arrival does not choose them."""
    total = docs.count()
    share = min(1.0, 2.0 * rows / max(1, total))
    some = docs.select(F.col(text).cast("binary").alias("text")).sample(share, seed=SAMPLE_SEED)
    some = some.orderBy(F.xxhash64("text")).limit(rows)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [x for batch in batches for x in batch["text"]]
        rejects = np.zeros((len(texts), len(RULES)), dtype=bool)
        for i, x in enumerate(texts):
            t = Text(x)
            rejects[i] = [rule(t) for rule in RULES.values()]
        chosen = greedy_order(rejects, feature_seconds(texts))
        out = pd.DataFrame(chosen, columns=["rule", "n", "rejected", "seconds"])
        yield out.assign(place=range(len(out)))

    schema = "rule string, n long, rejected long, seconds double, place int"
    return [r.asDict() for r in some.coalesce(1).mapInPandas(measured, schema).collect()]  # one row a rule


def cascade_order(profiled: list[dict]) -> list[str]:
    """The rules in the order of a profile; as listed without one."""
    order = [r["rule"] for r in sorted(profiled, key=lambda r: r["place"])]
    return order + [name for name in RULES if name not in order]


def rejection(text: Column, order: list[str]) -> Column:
    """Name of the rule that rejects the text first in this order; null if none does."""

    @F.pandas_udf("string")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([rejected_by(Text(x), order) for x in texts], dtype=object)

    return judge(text.cast("binary"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, unchanged."""
    order = cascade_order(profile(docs, text))
    return docs.where(rejection(F.col(text), order).isNull())


def report(text: Column, order: list[str]) -> Column:
    """The counts behind the base rules, and the verdict: the cascade runs for texts
    that pass the base rules."""

    @F.pandas_udf(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean"
    )
    def measure(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            t = Text(x)
            failed = base_failed(t)
            kept = not failed and rejected_by(t, order) is None
            out.append(
                (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept)
            )
        return pd.DataFrame(
            out,
            columns=[
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept",
            ],
        )

    return measure(text.cast("binary"))
