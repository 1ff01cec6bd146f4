"""The conditions of the detectors over hits, in the task that found them.

``detectors.py`` says them as expressions over one text column; those are evaluated hit by hit
without being compiled.  Here a detector takes the hits of its rule sets and gives its spans, so
that only spans leave the task.  Both give the same spans (``tests/test_search.py``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Sequence

import pyarrow as pa

from veilframe.functions.search import Hit
from veilframe.operators import rules as R

SPAN_FIELDS = (
    ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("confidence", pa.float64()),
    ("value", pa.string()), ("ctx_from", pa.int32()), ("ctx_to", pa.int32()),
)
SPAN_ARROW = pa.struct(SPAN_FIELDS)

#: In the order of the fields above.
Span = tuple[int, int, str, float, str, int, int]
Hits = dict[str, list[Hit]]
Test = Callable[[str], re.Match | None]


def any_of(words: Sequence[str]) -> Test:
    return re.compile("|".join(map(re.escape, words))).search


def before(text: str, hit: Hit, width: int) -> str:
    """Lower-cased characters just before a hit."""
    return text[max(hit[2] - width, 0) : hit[2]].lower()


def spans(hits: Sequence[Hit], category: str, confidence: float, left: int = 20, right: int = 20) -> list[Span]:
    return [(h[2], h[3], category, confidence, h[5], h[2] - left, h[3] + right) for h in hits]


def around_match(hits: Sequence[Hit], category: str, confidence: float, left: int = 20, right: int = 20) -> list[Span]:
    """Spans whose context surrounds the whole match."""
    return [(h[2], h[3], category, confidence, h[5], h[1] - left, h[4] + right) for h in hits]


def overlap(a: Span, b: Span) -> bool:
    return a[1] > b[0] and a[0] < b[1]


def beside(some: list[Span], taken: list[Span]) -> list[Span]:
    """Those that overlap no taken one."""
    return [s for s in some if not any(overlap(s, t) for t in taken)]


# --- structured values ---------------------------------------------------------


def emails(text: str, hits: Hits) -> list[Span]:
    return spans(hits["emails"], "EMAIL", 0.99)


def phones(text: str, hits: Hits) -> list[Span]:
    return spans(hits["phones"], "PHONE", 0.95)


def ibans(text: str, hits: Hits) -> list[Span]:
    return spans([h for h in hits["ibans"] if "XX" not in h[5] and "xx" not in h[5]], "IBAN", 0.95)


_birth_word = any_of(R.BIRTH_WORDS)


def birth_dates(text: str, hits: Hits) -> list[Span]:
    return spans([h for h in hits["birth_dates"] if _birth_word(before(text, h, 30))], "DOB", 0.90, left=30)


def addresses(text: str, hits: Hits) -> list[Span]:
    return spans([h for h in hits["addresses"] if "\n" not in h[5]], "ADDRESS", 0.85, left=30)


_id_word, _ssn_word = any_of(R.ID_WORDS), any_of(R.SSN_WORDS)
_ID_KINDS = [r.kind for r in R.ID_RULES]
_NOT_DIGIT = re.compile("[^0-9]")
_PARTING = re.compile("[-. ]")


def bsn_check(value: str) -> bool:
    digits = _NOT_DIGIT.sub("", value)
    if len(digits) != len(R.BSN_WEIGHTS):
        return False
    return sum(int(d) * w for d, w in zip(digits, R.BSN_WEIGHTS)) % 11 == 0


def national_ids(text: str, hits: Hits, words: Test = _id_word) -> list[Span]:
    out = []
    for h in hits["national_ids"]:
        kind, shown = _ID_KINDS[h[0]], before(text, h, 50)
        context = bool(words(shown))
        if kind == "NL_BSN":
            accepted = context or bsn_check(h[5])
        elif kind == "US_SSN":
            accepted = bool(_ssn_word(shown))
        elif kind == "BE_NATIONAL":
            accepted = context or len(_PARTING.sub("", h[5])) != 11
        else:
            accepted = context or kind != "PASSPORT"
        if accepted:
            out += spans((h,), "ID", 0.85 if context else 0.70, left=30)
    return out


def roads(text: str, hits: Hits) -> list[Span]:
    return spans(hits["roads"], "ROAD", 0.95)


# --- places and streets ----------------------------------------------------------

_ARTICLES, _KNOWN = frozenset(R.ARTICLES), frozenset(R.KNOWN_PLACES)
_NOT_CONTEXT_PLACES = frozenset(R.CONTEXT_PLACE_STOPWORDS)
_NO_STREETS = frozenset(R.STREET_SUFFIXES) | frozenset(R.NOT_STREETS)


def places(text: str, hits: Hits) -> list[Span]:
    known = spans(hits["gazetteer_places"], "PLACE", 0.95)
    new = [
        h for h in hits["preposition_places"]
        if len(h[5]) >= 3 and h[5].lower() not in _ARTICLES and h[5] not in _KNOWN
    ]
    at = {s[:2] for s in known}
    return known + [s for s in around_match(new, "PLACE", 0.75) if s[:2] not in at]


def context_places(text: str, hits: Hits) -> list[Span]:
    chosen = [h for h in hits["context_places"] if len(h[5]) >= 3 and h[5] not in _NOT_CONTEXT_PLACES]
    return around_match(chosen, "PLACE", 0.90, left=10, right=10)


def any_street(text: str, hits: Hits) -> list[Span]:
    def wanted(value: str) -> bool:
        lowered = value.lower()
        return len(value) >= 6 and lowered not in _NO_STREETS and not lowered.endswith("ering")

    return spans([h for h in hits["any_street"] if wanted(h[5])], "STREET", 0.88)


# --- persons ---------------------------------------------------------------------

_EXCLUDED_NAMES, _PLACE_ENDINGS = frozenset(R.NAME_EXCLUSIONS), frozenset(R.NAME_PLACE_ENDINGS)
_region_word = any_of(R.NAME_REGION_WORDS)
_BLANK = re.compile(f"[{re.escape(R.WHITE_SPACE)}]")


def names(text: str, hits: Hits) -> list[Span]:
    def wanted(value: str) -> bool:
        if len(value) < 5 or "\n" in value:
            return False
        upper = value.upper()
        if upper in _EXCLUDED_NAMES or _region_word(upper):
            return False
        return _BLANK.split(value.lower())[-1] not in _PLACE_ENDINGS

    return spans([h for h in hits["names"] if wanted(h[5])], "PERSON", 0.80, left=30)


def at_run_ends(runs: Sequence[Hit], first: re.Pattern, middle: re.Pattern | None, last: re.Pattern, two_words: bool = False) -> list[Hit]:
    """Runs of name characters to the longest name that ends where its run ends, as
    ``detectors._names_at_run_ends`` says."""

    def last_unlike(words: list[str], form: re.Pattern, upto: int) -> int:
        for i in range(upto - 1, -1, -1):
            if words[i] and not form.fullmatch(words[i]):
                return i
        return 0

    out = []
    for h in runs:
        trimmed = h[5].rstrip(R.WHITE_SPACE)
        words = _BLANK.split(trimmed)
        earliest = last_unlike(words, last, len(words))
        if middle is not None:
            earliest = last_unlike(words, middle, earliest + 1)
        for k in range(earliest, len(words) - 1 if two_words else len(words)):
            head = first.search(words[k])
            if head:
                value = trimmed[len(trimmed) - sum(map(len, words[k + 1 :])) - (len(words) - k - 1) - len(head[0]) :]
                end = h[2] + len(trimmed)
                out.append((0, end - len(value), end - len(value), end, end, value))
                break
    return out


_CHARS = r"a-zA-Zé'\-"
_DATED = (re.compile(rf"[A-Z][{_CHARS}]+\Z"), re.compile(r"[A-Z]?[a-zé'\-]+"), re.compile(rf"[A-Z][{_CHARS}]+"))
_PLACED = (re.compile(r"[A-Z][a-z]+\Z"), None, re.compile(r"[A-Z][a-z]+"))
_INNER_NAME = re.compile(r"([\s\S]*)(?:(?<=\s)Nationaliteit|(?<=[a-z])geboren)")
_NOT_BEFORE_DATE, _NOT_CAPS = frozenset(R.NAME_BEFORE_DATE_STOPWORDS), frozenset(R.CAPS_NAME_STOPWORDS)


def names_by_context(text: str, hits: Hits) -> list[Span]:
    runs = at_run_ends(hits["names_before_date"], *_DATED)
    dated = spans(
        [h for h in runs if len(h[5]) >= 3 and h[5].lower() not in _NOT_BEFORE_DATE], "PERSON", 0.88, 10, 30
    )
    caps = []
    for h in hits["caps_names"]:
        name = h[5]
        if h[4] <= h[3]:
            inner = _INNER_NAME.match(name)
            name = inner[1].rstrip(R.WHITE_SPACE) if inner else ""
        if name and name not in _NOT_CAPS:
            end = h[2] + len(name)
            caps += spans(((0, h[2], h[2], end, end, name),), "PERSON", 0.85, 10, 30)
    caps = beside(caps, dated)
    runs = at_run_ends(hits["names_before_placeholder"], *_PLACED, two_words=True)
    placed = spans([h for h in runs if len(h[5]) >= 4], "PERSON", 0.82, 10, 30)
    at = {s[:2] for s in dated + caps}
    return dated + caps + [s for s in placed if s[:2] not in at]


# --- vehicles --------------------------------------------------------------------


def vehicles(text: str, hits: Hits) -> list[Span]:
    brands = spans([h for h in hits["vehicle_brands"] if len(h[5]) >= 3], "VEHICLE", 0.92)
    kept: list[Span] = []
    for s in beside(spans(hits["vehicle_models"], "VEHICLE", 0.88), brands):
        if not any(overlap(s, k) for k in kept):
            kept.append(s)
    return brands + kept


JUDGES: dict[str, Callable[[str, Hits], list[Span]]] = {
    f.__name__: f
    for f in (
        emails, phones, ibans, birth_dates, addresses, national_ids, vehicles, roads, any_street,
        context_places, places, names_by_context, names,
    )
}


# --- choosing ----------------------------------------------------------------------


def resolved(found: list[Span]) -> list[Span]:
    """The greedy choice of disjoint spans of ``functions.spans.resolve_overlaps``."""
    starts: list[int] = []  # of those chosen, which are disjoint, hence in order
    chosen: list[Span] = []
    for s in sorted(found, key=lambda s: (-s[3], s[0] - s[1])):
        ahead = bisect_left(starts, s[1])  # those that start before this one ends
        if not ahead or chosen[ahead - 1][1] <= s[0]:
            starts.insert(ahead, s[0])
            chosen.insert(ahead, s)
    return chosen


def as_arrow(found: Sequence[list[Span]]) -> pa.ListArray:
    """Lists of spans as a column of lists."""
    offsets, flat = [0], []
    for some in found:
        flat += some
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(SPAN_FIELDS)
    fields = list(SPAN_ARROW)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
