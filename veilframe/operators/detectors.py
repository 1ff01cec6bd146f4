"""Detectors: SQL expressions from a text column to an array of spans.

Every detector is a narrow expression, so any number of them runs in one scan
of the documents.  ``text`` is the name of a column that went through
``spans.scannable``; ``column`` and ``detect`` turn detectors into columns.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.search import Searches
from veilframe.functions.spans import bind, literal, literals
from veilframe.operators import judged as J
from veilframe.operators import rules as R

Detector = Callable[..., str]


def _any_word(words: Sequence[str]) -> str:
    """Regex literal that finds any of the words as a substring."""
    return literal("|".join(rf"\Q{w}\E" for w in words))


def _before(text: str, width: int) -> str:
    """Lower-cased characters just before hit ``h``."""
    begin = f"greatest(h.start - {width}, 0)"
    return f"lower(substring({text}, {begin} + 1, h.start - {begin}))"


def _matches(value: str, regex: str) -> str:
    return f"{value} RLIKE {literal(regex)}"


def scan(text: str, rules: str, gate: str | None) -> str:
    """Hits of a set of rules."""
    return S.scan(text, RULE_SETS[rules], gate)


ONE_LINE = "NOT contains(h.value, '\n')"


# --- structured values ---------------------------------------------------------


def emails(text: str) -> str:
    return S.to_spans(scan(text, "emails", f"contains({text}, '@')"), "EMAIL", "0.99")


def phones(text: str) -> str:
    # Every phone pattern holds at least seven digits with only these between.
    gate = _matches(text, r"(?U)\d(?:[-/.()\s]*+\d){6}")
    return S.to_spans(scan(text, "phones", gate), "PHONE", "0.95")


def ibans(text: str) -> str:
    found = scan(text, "ibans", _matches(text, r"(?U)[A-Z]{2}\d{2}"))
    return S.to_spans(found, "IBAN", "0.95", "NOT h.value RLIKE 'XX|xx'")


def birth_dates(text: str) -> str:
    """Dates with a birth word in the 30 characters before; other dates stay."""
    found = scan(text, "birth_dates", _matches(text, r"(?U)\d[-/.]\d"))
    where = f"{_before(text, 30)} RLIKE {_any_word(R.BIRTH_WORDS)}"
    return S.to_spans(found, "DOB", "0.90", where, left=30)


def addresses(text: str) -> str:
    found = scan(text, "addresses", _matches(text, r"(?U)\d"))
    return S.to_spans(found, "ADDRESS", "0.85", ONE_LINE, left=30)


def bsn_check(value: str) -> str:
    """Nine digits whose weighted sum is divisible by eleven."""
    total = " + ".join(
        f"cast(substring(digits, {i + 1}, 1) AS int) * ({w})" for i, w in enumerate(R.BSN_WEIGHTS)
    )
    return bind(
        f"regexp_replace({value}, '[^0-9]', '')",
        "digits",
        f"if(length(digits) = {len(R.BSN_WEIGHTS)}, ({total}) % 11 = 0, false)",
    )


def national_ids(text: str) -> str:
    """Id numbers; the ambiguous kinds need a check sum or a word before them."""

    def of_kind(kind: str) -> str:
        return f"h.rule IN ({', '.join(str(i) for i, r in enumerate(R.ID_RULES) if r.kind == kind)})"

    accepted = (
        f"CASE WHEN {of_kind('NL_BSN')} THEN context OR {bsn_check('h.value')} "
        f"WHEN {of_kind('US_SSN')} THEN before RLIKE {_any_word(R.SSN_WORDS)} "
        f"WHEN {of_kind('BE_NATIONAL')} "
        "THEN context OR length(regexp_replace(h.value, '[-. ]', '')) <> 11 "
        f"WHEN {of_kind('PASSPORT')} THEN context ELSE true END"
    )
    judged = (
        f"transform({scan(text, 'national_ids', _matches(text, r'(?U)\d\d'))}, h -> "
        + bind(
            _before(text, 50),
            "before",
            bind(
                f"before RLIKE {_any_word(R.ID_WORDS)}",
                "context",
                "named_struct('rule', h.rule, 'lead', h.lead, 'start', h.start, 'end', h.`end`, "
                "'stop', h.stop, 'value', h.value, 'context', context, "
                f"'accepted', {accepted})",
            ),
        )
        + ")"
    )
    return S.to_spans(judged, "ID", "if(h.context, 0.85, 0.70)", "h.accepted", left=30)


def roads(text: str) -> str:
    return S.to_spans(scan(text, "roads", None), "ROAD", "0.95")


# --- places and streets ----------------------------------------------------------


def gazetteer_places(
    text: str, places: Sequence[str] = R.KNOWN_PLACES, words: str | None = None
) -> str:
    found = S.scan_names(text, places, words=words)
    return S.to_spans(found, "PLACE", "0.95")


def preposition_places(
    text: str, places: Sequence[str] = R.KNOWN_PLACES
) -> str:
    """Capitalised word after a preposition that the gazetteer does not know."""
    where = (
        f"length(h.value) >= 3 AND lower(h.value) NOT IN ({literals(R.ARTICLES)}) "
        f"AND h.value NOT IN ({literals(places)})"
    )
    found = scan(text, "preposition_places", None)
    return S.to_spans(found, "PLACE", "0.75", where, around_match=True)


def places(
    text: str, known: Sequence[str] = R.KNOWN_PLACES, words: str | None = None
) -> str:
    new = f"NOT exists(known, k -> {S.SAME_PLACE_SQL.format('s', 'k')})"
    return bind(
        gazetteer_places(text, known, words),
        "known",
        f"concat(known, filter({preposition_places(text, known)}, s -> {new}))",
    )


def context_places(text: str) -> str:
    where = f"length(h.value) >= 3 AND h.value NOT IN ({literals(R.CONTEXT_PLACE_STOPWORDS)})"
    found = scan(text, "context_places", None)
    return S.to_spans(found, "PLACE", "0.90", where, left=10, right=10, around_match=True)


def named_streets(text: str) -> str:
    """Street names without a house number after them."""
    number_follows = _matches(f"substring({text}, h.`end` + 1, 10)", r"(?U)^\s*\d")
    where = f"length(h.value) >= 5 AND {ONE_LINE} AND NOT {number_follows}"
    return S.to_spans(scan(text, "named_streets", None), "STREET", "0.85", where)


def any_street(text: str) -> str:
    """Any word that ends like a street, minus words known not to be one."""
    where = (
        f"length(h.value) >= 6 AND lower(h.value) NOT IN ({literals(R.STREET_SUFFIXES)}) "
        f"AND lower(h.value) NOT IN ({literals(R.NOT_STREETS)}) "
        "AND NOT endswith(lower(h.value), 'ering')"
    )
    return S.to_spans(scan(text, "any_street", None), "STREET", "0.88", where)


# --- persons ---------------------------------------------------------------------


def names(text: str) -> str:
    where = (
        f"length(h.value) >= 5 AND upper(h.value) NOT IN ({literals(R.NAME_EXCLUSIONS)}) "
        f"AND NOT upper(h.value) RLIKE '{'|'.join(R.NAME_REGION_WORDS)}' "
        f"AND element_at(split(lower(h.value), {literal(r'(?U)\s+')}), -1) "
        f"NOT IN ({literals(R.NAME_PLACE_ENDINGS)}) AND {ONE_LINE}"
    )
    return S.to_spans(scan(text, "names", None), "PERSON", "0.80", where, left=30)


TRAILING_BLANKS = r"(?U)(?<!\s)\s+\z"


def _hit(start: str, end: str, value: str) -> str:
    return (
        f"named_struct('rule', 0, 'lead', {start}, 'start', {start}, 'end', {end}, "
        f"'stop', {end}, 'value', {value})"
    )


def _names_at_run_ends(
    runs: str, first: str, middle: str | None, last: str, two_words: bool = False
) -> str:
    """Hits of runs of name characters to hits of the longest name that ends
    where its run ends.

    The name is a word with suffix ``first``, then words of form ``middle``,
    then words of form ``last``.  Found by looking at the words from the right:
    the last word not of form ``last`` closes the middle part, the last word
    before it not of form ``middle`` is the earliest place to start.  This
    replaces nested repetition in a regex, which is super-linear and recursive.
    ``two_words`` asks for at least one word after the first.
    """

    def last_word_unlike(form: str, upto: str) -> str:
        unlike = f"elt_i <> '' AND NOT {_matches('elt_i', f'^(?:{form})$')}"
        positions = f"transform(words, (elt_i, i) -> if(i < {upto} AND {unlike}, i + 1, 0))"
        return f"greatest(array_max({positions}), 1)"

    heads = f"i >= earliest AND {_matches('element_at(words, i)', f'{first}$')}"
    if two_words:  # the last word of a trimmed run is never empty
        heads += " AND i < size(words)"
    name = (
        f"array_join(concat(array(regexp_extract(element_at(words, k), {literal(f'{first}$')}, 0)), "
        "slice(words, k + 1, size(words))), ' ')"
    )
    end = "(h.start + length(trimmed))"
    found = f"array({_hit(f'{end} - length({name})', end, f'right(trimmed, length({name}))')})"
    from_start = bind(
        f"array_min(filter(sequence(1, size(words)), i -> {heads}))",
        "k",
        f"if(k IS NULL, {S.NO_HITS}, {found})",
    )
    closes = last_word_unlike(last, "size(words)")
    earliest = "closes" if middle is None else last_word_unlike(middle, "closes")
    body = bind(closes, "closes", bind(earliest, "earliest", from_start))
    body = bind(f"split(trimmed, {literal(r'(?U)\s')}, -1)", "words", body)
    body = bind(f"regexp_replace(h.value, {literal(TRAILING_BLANKS)}, '')", "trimmed", body)
    return f"flatten(transform({runs}, h -> {body}))"


# Runs of characters that names before a date may hold, up to the date.  Classes are asked
# part by part: small letters, the most, come first, and white space last.
_NAME_CHARS = r"a-zA-Zé\'\-"
_RUN_BEFORE_DATE = R.Rule(
    value=rf"(?<![{_NAME_CHARS}\s])[{_NAME_CHARS}\s]+", trail=r"[-–]\s*" + R.DATE,
    pivot=r"[-–]\s*\d",
    run=string.ascii_letters + "é'-" + R.WHITE_SPACE,
)
_RUN_BEFORE_PLACEHOLDER = R.Rule(
    value=r"(?<![a-zA-Z\s])[a-zA-Z\s]+", trail=r"(?<=\s)PERSON_\d{3,4}",
    pivot=r"(?<=\s)PERSON_\d",
    run=string.ascii_letters + R.WHITE_SPACE,
)
# A capital word and its maximal chain of capitalised words, with what follows.
_CAPS_CHAIN = R.Rule(
    value=r"\b(?:[A-Z]{3,}(?=PERSON_|Nationaliteit)|[A-Z]{3,}+(?:\s+[A-Z][a-z]+)*+)",
    trail=r"(?:\s*(?:[-–]\s*\d{1,2}[-/\.]|Nationaliteit|PERSON_|geboren))?",
    head="[A-Z]",
    word="[A-Z]{3}",
)


def names_before_date(text: str) -> str:
    found = _names_at_run_ends(
        scan(text, "names_before_date", _matches(text, r"(?U)[-–]\s*\d")),
        first=rf"[A-Z][{_NAME_CHARS}]+",
        middle=r"[A-Z]?[a-zé\'\-]+",
        last=rf"[A-Z][{_NAME_CHARS}]+",
    )
    where = (
        "length(h.value) >= 3 "
        f"AND lower(h.value) NOT IN ({literals(R.NAME_BEFORE_DATE_STOPWORDS)})"
    )
    return S.to_spans(found, "PERSON", "0.88", where, left=10, right=30)


def caps_names(text: str) -> str:
    # Without a follow-up after the whole chain, the name may still end before
    # the last follow-up word inside the chain.
    inner = (
        "regexp_extract(h.value, "
        + literal(r"(?U)^([\s\S]*)(?:(?<=\s)Nationaliteit|(?<=[a-z])geboren)")
        + ", 1)"
    )
    name = f"if(h.stop > h.`end`, h.value, regexp_replace({inner}, {literal(TRAILING_BLANKS)}, ''))"
    gate = _matches(text, r"(?U)[-–]\s*\d|Nationaliteit|PERSON_|geboren")
    found = (
        f"transform({scan(text, 'caps_names', gate)}, h -> "
        + bind(name, "v", _hit("h.start", "h.start + length(v)", "v"))
        + ")"
    )
    where = f"h.value <> '' AND h.value NOT IN ({literals(R.CAPS_NAME_STOPWORDS)})"
    return S.to_spans(found, "PERSON", "0.85", where, left=10, right=30)


def names_before_placeholder(text: str) -> str:
    found = _names_at_run_ends(
        scan(text, "names_before_placeholder", f"contains({text}, 'PERSON_')"),
        first=r"[A-Z][a-z]+",
        middle=None,
        last=r"[A-Z][a-z]+",
        two_words=True,
    )
    return S.to_spans(found, "PERSON", "0.82", "length(h.value) >= 4", left=10, right=30)


def names_by_context(text: str) -> str:
    """Names before a birth date, capital names before a follow-up, and names
    before an existing placeholder."""
    free = f"NOT exists(dated, d -> {S.OVERLAP_SQL.format('s', 'd')})"
    same = S.SAME_PLACE_SQL.format("s", "d")
    new = f"NOT exists(dated, d -> {same}) AND NOT exists(caps, d -> {same})"
    return bind(
        names_before_date(text),
        "dated",
        bind(
            f"filter({caps_names(text)}, s -> {free})",
            "caps",
            f"concat(dated, caps, filter({names_before_placeholder(text)}, s -> {new}))",
        ),
    )


# --- vehicles --------------------------------------------------------------------


def vehicle_brands(
    text: str, brands: Sequence[str] = R.VEHICLE_BRANDS, words: str | None = None
) -> str:
    found = S.scan_names(text, brands, R.BRAND_TAIL, words)
    return S.to_spans(found, "VEHICLE", "0.92", "length(h.value) >= 3")


def vehicle_models(
    text: str, models: Sequence[str] = R.VEHICLE_MODELS, words: str | None = None
) -> str:
    found = S.scan_names(text, models, words=words)
    return S.to_spans(found, "VEHICLE", "0.88")


def models_beside_brands(
    text: str,
    brands: str,
    models: Sequence[str] = R.VEHICLE_MODELS,
    words: str | None = None,
) -> str:
    """Model spans that overlap no brand span nor an earlier model span."""
    beside = f"NOT exists({brands}, k -> {S.OVERLAP_SQL.format('s', 'k')})"
    free = f"NOT exists(kept, k -> {S.OVERLAP_SQL.format('s', 'k')})"
    return (
        f"aggregate(filter({vehicle_models(text, models, words)}, s -> {beside}), {S.NO_SPANS}, "
        f"(kept, s) -> if({free}, array_append(kept, s), kept))"
    )


def vehicles(
    text: str,
    brands: Sequence[str] = R.VEHICLE_BRANDS,
    models: Sequence[str] = R.VEHICLE_MODELS,
    words: str | None = None,
) -> str:
    return bind(
        vehicle_brands(text, brands, words),
        "brands",
        f"concat(brands, {models_beside_brands(text, 'brands', models, words)})",
    )


# --- what the detectors look for ----------------------------------------------------

RULE_SETS: dict[str, Sequence[R.Rule]] = {
    "emails": R.EMAIL_RULES,
    "phones": R.PHONE_RULES,
    "ibans": R.IBAN_RULES,
    "birth_dates": R.DATE_RULES,
    "addresses": R.ADDRESS_RULES,
    "national_ids": R.ID_RULES,
    "roads": R.ROAD_RULES,
    "any_street": R.ANY_STREET_RULES,
    "named_streets": R.NAMED_STREET_RULES,
    "context_places": R.CONTEXT_PLACE_RULES,
    "preposition_places": R.PREPOSITION_PLACE_RULES,
    "names_before_date": [_RUN_BEFORE_DATE],
    "caps_names": [_CAPS_CHAIN],
    "names_before_placeholder": [_RUN_BEFORE_PLACEHOLDER],
    "names": R.NAME_RULES,
}
NAME_SETS = {
    "gazetteer_places": (R.KNOWN_PLACES, ""),
    "vehicle_brands": (R.VEHICLE_BRANDS, R.BRAND_TAIL),
    "vehicle_models": (R.VEHICLE_MODELS, ""),
}
# Sets of the detectors that have others than the one of their name.
_SETS_OF = {
    "vehicles": ("vehicle_brands", "vehicle_models"),
    "places": ("gazetteer_places", "preposition_places"),
    "names_by_context": ("names_before_date", "caps_names", "names_before_placeholder"),
}


@cache
def _searches(sets: tuple[str, ...]) -> Searches:
    return Searches(
        {s: RULE_SETS[s] for s in sets if s in RULE_SETS}, {s: NAME_SETS[s] for s in sets if s in NAME_SETS}
    )


# --- detector sets ---------------------------------------------------------------

DETECTORS: dict[str, Detector] = {
    "emails": emails,
    "phones": phones,
    "ibans": ibans,
    "birth_dates": birth_dates,
    "addresses": addresses,
    "national_ids": national_ids,
    "vehicles": vehicles,
    "roads": roads,
    "any_street": any_street,
    "named_streets": named_streets,
    "context_places": context_places,
    "places": places,
    "names_by_context": names_by_context,
    "names": names,
}

# Order decides ties between spans of equal confidence and length.
PATTERN_ORDER = (
    "emails", "ibans", "phones", "vehicles", "roads", "birth_dates", "addresses",
    "any_street", "context_places", "places", "national_ids", "names_by_context", "names",
)
HYBRID_ORDER = (
    "emails", "phones", "ibans", "birth_dates", "national_ids", "vehicles", "roads",
    "any_street", "context_places", "places", "names_by_context", "names",
)


def column(detector: Detector, text: str) -> Column:
    """Result of one detector on its own: one span per place."""
    return S.first_per_place(F.expr(detector(text)))


# What detectors of a set can share: the words of the text, and whether it holds
# a digit at all.
_USE_WORDS = ("places", "vehicles")
_NEED_DIGITS = ("phones", "ibans", "birth_dates", "addresses", "national_ids", "roads")


TEXTS_AT_ONCE = 256


def hits(text: str, order: Sequence[str] = PATTERN_ORDER, resolve: bool = False) -> Column:
    """Candidates of several detectors in list order, overlaps included, found in one pass over
    the texts; with ``resolve``, the disjoint ones that ``spans.resolve_overlaps`` chooses.

    The words that vouch for an id number are an argument, as they were a literal of the
    expression: a plan shows by them how often the detection stands in it."""
    sets = tuple(dict.fromkeys(s for name in order for s in _SETS_OF.get(name, (name,))))

    def found(texts: pa.Array, *id_words: pa.Array) -> pa.Array:
        searches, judges = _searches(sets), [J.JUDGES[name] for name in order]
        if id_words and len(texts):
            own = partial(J.national_ids, words=J.any_of(id_words[0][0].as_py().split("|")))
            judges[order.index("national_ids")] = own

        def spans(text: str | None) -> list[J.Span]:
            if not text:
                return []
            of_sets = dict(zip(searches.sets, searches.hits(text)))
            spans = [s for judge in judges for s in judge(text, of_sets)]
            return J.resolved(spans) if resolve else spans

        # Some texts at a time: as Python objects the spans take several times their room.
        parts = [texts.slice(at, TEXTS_AT_ONCE) for at in range(0, len(texts), TEXTS_AT_ONCE)]
        return pa.concat_arrays([J.as_arrow([spans(t) for t in part.to_pylist()]) for part in parts or [texts]])

    id_words = [F.lit("|".join(R.ID_WORDS))] if "national_ids" in order else []
    return F.arrow_udf(found, f"array<{S.SPAN_TYPE}>")(F.col(text), *id_words)


def detect(text: str, order: Sequence[str] = PATTERN_ORDER, hits: str | None = None) -> Column:
    """Candidates of several detectors in list order, overlaps included.

    ``hits`` names the column that ``hits`` gave for the same text and order.  Without it
    each rule is an expression over the text, which needs no Python but walks it once a rule.
    """
    if hits is not None:
        return F.col(hits)

    def found(name: str) -> str:
        detector = DETECTORS[name]
        if name in _USE_WORDS:
            return detector(text, words="words")
        if name in _NEED_DIGITS:
            return f"if(has_digit, {detector(text)}, {S.NO_SPANS})"
        return detector(text)

    spans = "concat(" + ", ".join(found(name) for name in order) + ")"
    has_digit = _matches(text, r"\p{Nd}")
    return F.expr(bind(S.words_of(text), "words", bind(has_digit, "has_digit", spans)))
