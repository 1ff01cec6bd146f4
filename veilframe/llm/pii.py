r"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over the text once and reports anchors: at-signs,
``://``, ``+`` before a digit, digits, and cue words such as ``IBAN`` or ``SSN``.  At
each anchor a local parser reads to the left and right as far as its kind's characters
go, and checks what it read.  A parser starts where the last span of its kind ended and
skips anchors it has passed, so the work is linear in the text.

Kinds, in the order in which spans are listed:

* ``email``, ``ip``, ``card``, ``phone``: exactly the leftmost non-overlapping matches of
  the fixed patterns (``BASE``) that pass their check; what fails is not tried again.
* ``card_part``, ``phone_part``: numbers inside a run of digits that fails as a whole,
  such as a card written behind a phone: an unbroken group of 13 to 19 digits or
  groups of 4-4-4-4 and 4-6-5 that pass Luhn; the first groups behind a ``+`` that have
  9 to 15 digits together.
* ``login``: user information and host behind ``://``.
* ``iban``: behind its cue, check digits right.  ``ssn`` and ``account``: behind a cue.

Offsets are code points, ends exclusive.  A null text is empty; an empty text has no
spans.  Spans of one kind never overlap; those of two kinds may, and are listed by kind,
then start, so there are no ties.  Rows are scanned one by one: repeated rows get equal
spans, an empty table gives an empty result.  A text of any length is scanned whole, in
memory of its task.  Results are column expressions, so no name of the input is touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds whose spans are fixed, and what they match before their check.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "card_part", "phone_part", "login", "iban", "ssn", "account")

CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
IBAN_MOST = 34

IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "rekening")

Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
GROUP = re.compile(r"[0-9]+")
PHONE_TAIL = re.compile(r"[\x20().0-9-]+")
AUTHORITY = re.compile(r"[^\s/?#\"'<>\x5c]+")
IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
SSN = re.compile(
    r"[\s:#.]{0,3}((?!000|666|9)[0-9]{3}([-\x20])(?!00)[0-9]{2}\2(?!0000)[0-9]{4})(?![0-9])"
)
ACCOUNT = re.compile(
    r"(?:[\s:#.]{0,3}(?:number|num|no|nr)\b)?[\s:#.]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])"
)


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-1][::2])) % 10 == 0


def is_card(digits: str) -> bool:
    return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def is_byte(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def iban_length(text: str) -> int:
    """Characters of the longest start of ``text`` whose check digits are right and
    which ends where a word does; 0 for none."""
    for end in range(len(text), 14, -1):
        if end < len(text) and text[end] != " ":
            continue
        plain = text[:end].replace(" ", "")
        if 15 <= len(plain) <= IBAN_MOST:
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return end
    return 0


class Scan:
    """One text: the spans found so far and how far each parser has read."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[Span] = []
        self.read = [0] * len(KINDS)

    def add(self, kind: str, start: int, end: int) -> None:
        k = KINDS.index(kind)
        self.found.append((k, start, end))
        self.read[k] = end

    def email(self, at: int) -> None:
        """``at`` is the sign; to the left up to the last e-mail."""
        domain = DOMAIN.match(self.text, at + 1)
        begin = at
        while begin > self.read[0] and self.text[begin - 1] in LOCAL:
            begin -= 1
        if domain and begin < at:
            self.add("email", begin, domain.end())

    def number(self, at: int) -> None:
        """``at`` is a digit: addresses and cards that begin there."""
        if at >= self.read[1]:
            dotted = DOTTED.match(self.text, at)
            parts = list(GROUP.finditer(self.text, at, dotted.end()))
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(is_byte(p[0]) for p in four):
                    self.add("ip", four[0].start(), four[3].end())
            self.read[1] = dotted.end()
        if at >= self.read[2]:
            chain = CHAIN.match(self.text, at)
            digits = digits_of(chain[0])
            if is_card(digits):
                self.add("card", *chain.span())
            elif len(digits) > CARD_DIGITS[0]:
                self.card_parts(*chain.span())
            self.read[2] = chain.end()

    def card_parts(self, begin: int, end: int) -> None:
        groups = [m.span() for m in GROUP.finditer(self.text, begin, end)]
        i = 0
        while i < len(groups):
            sizes = [b - a for a, b in groups[i : i + 4]]
            many = 1 if sizes[0] >= CARD_DIGITS[0] else 4 if sizes == [4] * 4 else 3 if sizes[:3] == [4, 6, 5] else 0
            start, stop = groups[i][0], groups[i + max(many, 1) - 1][1]
            if many and (start, stop) != (begin, end) and is_card(digits_of(self.text[start:stop])):
                self.add("card_part", start, stop)
                i += many
            else:
                i += 1

    def phone(self, at: int) -> None:
        """``at`` is a plus sign before a digit."""
        tail = PHONE_TAIL.match(self.text, at + 2)
        if not tail:
            return
        end = tail.end()
        while not "0" <= self.text[end - 1] <= "9":
            end -= 1
        if end < at + 4:
            return
        digits = len(digits_of(self.text[at:end]))
        if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
            self.add("phone", at, end)
        elif digits > PHONE_DIGITS[1]:
            self.phone_part(at, end)

    def phone_part(self, at: int, end: int) -> None:
        digits, stop = 0, 0
        for m in GROUP.finditer(self.text, at, end):
            digits += len(m[0])
            if digits > PHONE_DIGITS[1]:
                break
            stop = m.end() if digits >= PHONE_DIGITS[0] else 0
        if stop:
            self.add("phone_part", at, stop)

    def login(self, at: int) -> None:
        """``at`` is the first character behind ``://``."""
        run = AUTHORITY.match(self.text, at)
        sign = self.text.rfind("@", at, run.end()) if run else -1
        if sign > at and sign + 1 < run.end():
            self.add("login", at, run.end())

    def cued(self, kind: str, pattern: re.Pattern, at: int) -> None:
        """``at`` is the first character behind a cue."""
        m = pattern.match(self.text, at)
        if not m or m.start(1) < self.read[KINDS.index(kind)]:
            return
        size = iban_length(m[1]) if kind == "iban" else len(m[1])
        if size:
            self.add(kind, m.start(1), m.start(1) + size)


def automaton() -> ahocorasick.Automaton:
    """Anchors with what is done behind the anchor's last character."""
    words = ahocorasick.Automaton()

    def cue(word: str, does: Callable[[Scan, int], None]) -> None:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            words.add_word(form, does)

    words.add_word("@", lambda scan, last: scan.email(last))
    words.add_word("://", lambda scan, last: scan.login(last + 1))
    for d in "0123456789":
        words.add_word(d, lambda scan, last: scan.number(last))
        words.add_word("+" + d, lambda scan, last: scan.phone(last - 1))
    for cues, kind, pattern in (
        (IBAN_CUES, "iban", IBAN), (SSN_CUES, "ssn", SSN), (ACCOUNT_CUES, "account", ACCOUNT)
    ):
        for word in cues:
            cue(word, lambda scan, last, k=kind, p=pattern: scan.cued(k, p, last + 1))
    words.make_automaton()
    return words


def spans_of(text: str | None, anchors: ahocorasick.Automaton) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    scan = Scan(text or "")
    for last, parse in anchors.iter(scan.text):
        parse(scan, last)
    return sorted(scan.found)


FIELDS = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def personal_spans(text: Column) -> Column:
    """Array of (kind, start, end); ``KINDS`` names the kinds."""

    @F.arrow_udf("array<struct<kind:int,start:long,end:long>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        for texts in batches:
            ends, cells = [0], []
            for value in texts:
                cells += spans_of(value.as_py(), anchors)
                ends.append(len(cells))
            columns = [pa.array([c[i] for c in cells], FIELDS.field(i).type) for i in range(3)]
            yield pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(FIELDS))
            )

    return scanned(text)


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string")),
    )
    return F.array_join(each, ",")


def redacted(text: Column) -> Column:
    """The text with ``[KIND]`` in place of each span; of spans that overlap, the first
    names the stretch."""

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        for texts in batches:
            yield pa.array([mask(value.as_py(), anchors) for value in texts], pa.string())

    return masked(text)


def mask(text: str | None, anchors: ahocorasick.Automaton) -> str:
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans_of(text, anchors)):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + (text or "")[done:]
