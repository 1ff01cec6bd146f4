"""License scans by ordered signature rules.

A text's keywords are found in one pass of an automaton; only rules whose keyword
occurs are searched.  Detections are resolved in the order of priority, then length,
then place (ties go by label): one that lies inside an accepted one is suppressed.  A
negative rule (``is not licensed under ...``) suppresses and is no detection itself.  Fixed
phrases are located beside the rules by words, and are never suppressed.

Texts are compared with A-Z in lower case.  Words are runs of ASCII letters and digits
and of anything beyond ASCII; places are word numbers from 0, spans are code points
with exclusive ends.

* A null text is empty and has no detections.  Rows are scanned one by one, so repeated
  rows get equal results; an empty table gives an empty result.  The result is a column
  expression; no name of the input is touched.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.llm.license_rules import Rule, rules

#: Label of each base phrase.
BASE = (
    (b"under the mit license", "mit"),
    (b"apache license version 2", "apache-2"),
    (b"cc by nc", "cc-by-nc"),
)

WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Scanner:
    def __init__(self) -> None:
        self.by_keyword: dict[str, list[Rule]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for word in self.by_keyword:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def detections(self, low: str) -> list[tuple[int, int, Rule, str]]:
        """start, end, rule, label of what stands after suppression, by place."""
        words = {word for _, word in self.automaton.iter(low)}
        found = [
            (m.start(), m.end(), rule, label_of(rule, m))
            for word in words
            for rule in self.by_keyword[word]
            for m in rule.pattern.finditer(low)
        ]
        found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[3] or ""))
        kept = [f for f in uncontained(found) if f[3] is not None]
        return sorted(kept, key=lambda f: (f[0], f[1], f[3]))


def label_of(rule: Rule, match) -> str | None:
    if rule.kind != "short":
        return rule.label
    return "-".join(["cc-by", *(g for g in match.groups() if g)])


def uncontained(found: list) -> Iterator:
    """Those not inside an earlier one.  Accepted spans are kept by start with the
    largest end so far among those that matter, none inside another."""
    starts: list[int] = []
    ends: dict[int, int] = {}
    for f in found:
        start, end = f[0], f[1]
        at = bisect_right(starts, start)
        if at and ends[starts[at - 1]] >= end:
            continue
        yield f
        while at < len(starts) and ends[starts[at]] <= end:  # now inside the new one
            del ends[starts.pop(at)]
        if at and starts[at - 1] == start:
            ends[start] = end
        else:
            insort(starts, start)
            ends[start] = end


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word number and label of every place of a base phrase."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE:
        wanted = b" " + phrase + b" "
        at = line.find(wanted)
        before = counted = 0
        while at >= 0:
            counted += line.count(b" ", before, at)
            before = at
            out.append((counted, label))
            at = line.find(wanted, at + 1)
    return out


def scan(text: bytes | None, scanner: Scanner) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    raw = text or b""
    words = raw.translate(WORD_BYTES).split()
    base = base_places(words)
    kept = scanner.detections(raw.lower().decode("utf-8", "replace"))
    places = [p for p, _ in base]
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(label for *_, label in kept)})
    score = max([1.0] * bool(base) + [rule.score for _, _, rule, _ in kept], default=0.0)
    spans = [{"start": s, "end": e, "label": label, "rule": rule.kind} for s, e, rule, label in kept]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(base_labels), ",".join(labels), score, spans,
    )


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<start:int,end:int,label:string,rule:string>>"
)


def licenses(text: Column) -> Column:
    """Struct of counts, labels, score and the spans behind them."""

    @F.pandas_udf(FIELDS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for texts in batches:
            out = pd.DataFrame([scan(t, scanner) for t in texts], columns=names)
            for name in ("first_word", "last_word"):
                out[name] = out[name].astype("Int64")
            yield out

    return scanned(text.cast("binary"))
