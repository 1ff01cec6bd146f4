"""The registered queries as SQL for DuckDB.

Written independently of the Spark operators: positions come from marked copies
of the text, overlaps are resolved by a list fold, entities by window functions.
The SQL regex engine has ASCII word boundaries and no look-around, so patterns
run on folded copies of the text in which each non-ASCII letter is replaced by
one ASCII word character; offsets stay the same and values are cut from the
original text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from veilframe.operators import rules as R
from veilframe.operators import detectors as D
from veilframe.plans.corpus import CASE_BASE, CASE_TEXT

LETTERS = (
    r"[\x{00AA}\x{00B2}\x{00B3}\x{00B5}\x{00B9}\x{00BA}\x{00BC}-\x{00BE}\x{00C0}-\x{00D6}"
    r"\x{00D8}-\x{00F6}\x{00F8}-\x{02C1}\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]"
)
MARKED = "concat(chr(1), '\\1', chr(1), '\\2', chr(1), '\\3', chr(1))"
SPAN = "doc_id, s, e, category, confidence, value, ctx_from, ctx_to, det, pat, seq"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(values: Sequence[str]) -> str:
    return ", ".join(quote(v) for v in values)


def fold(column: str) -> str:
    return f"regexp_replace({column}, '{LETTERS}', '_', 'g')"


# Folded copies: which special letters take part in a pattern's classes.
FOLDS = {
    "f_plain": fold("text"),
    "f_e": fold("replace(text, 'é', 'x')"),
    "f_ei": fold("translate(text, 'éÉ', 'xX')"),
    "f_de": fold("translate(text, 'äöüß', 'xxxx')"),
}


def folded_pattern(rule: R.Rule) -> tuple[str, str]:
    """Column to search and the pattern folded the same way."""
    pattern = f"({rule.lead})({rule.value})({rule.trail})"
    if "é" in pattern:
        column, special = ("f_ei" if rule.ignore_case else "f_e"), "é"
    elif "ä" in pattern:
        column, special = "f_de", "äöüß"
    else:
        column, special = "f_plain", ""
    folded = "".join(
        "x" if c in special else ("_" if c.isalpha() and not c.isascii() else c) for c in pattern
    )
    # No look-ahead here: such rules are filtered afterwards.
    folded = folded.replace(
        "(?!ERSTE|EERSTE|AANLEG|VLAANDEREN|NEDERLAND|FRANCE|GERMANY)", ""
    )
    return column, ("(?i)" if rule.ignore_case else "") + folded


def positions(name: str, source: str = "folded") -> str:
    """From marked copies ``{name}_m(doc_id, pat, parts)`` to hits."""
    return f"""{name}_h AS MATERIALIZED (
  SELECT doc_id, pat, i AS seq, before AS lead_s, before + length(parts[4*i+2]) AS s,
         before + length(parts[4*i+2]) + length(parts[4*i+3]) AS e,
         before + length(parts[4*i+2]) + length(parts[4*i+3]) + length(parts[4*i+4]) AS stop
  FROM (SELECT doc_id, pat, i, parts,
               cast(list_sum(list_transform(parts[1:4*i+1], lambda x: length(x))) AS BIGINT) AS before
        FROM (SELECT doc_id, pat, parts,
                     unnest(generate_series(0, (len(parts) - 1) // 4 - 1)) AS i
              FROM {name}_m WHERE len(parts) > 1))),
{name}_v AS (
  SELECT h.*, d.text, substring(d.text, cast(h.s + 1 AS BIGINT), cast(h.e - h.s AS BIGINT)) AS v
  FROM {name}_h h JOIN {source} d USING (doc_id))"""


def marked(name: str, rules: Sequence[R.Rule], source: str = "folded") -> str:
    selects = []
    for i, rule in enumerate(rules):
        column, pattern = folded_pattern(rule)
        selects.append(
            f"SELECT doc_id, {i} AS pat, string_split(regexp_replace({column}, {quote(pattern)}, "
            f"{MARKED}, 'g'), chr(1)) AS parts FROM {source}"
        )
    return f"{name}_m AS (\n  " + "\n  UNION ALL ".join(selects) + ")"


def marked_names(name: str, names: Sequence[str], tail: str = "") -> str:
    """One search per name, in the texts that hold its words."""
    selects = []
    for i, n in enumerate(sorted(names)):
        folded = "".join("_" if c.isalpha() and not c.isascii() else c for c in n)
        words = " " + re.sub("[^a-z0-9_]+", " ", folded.lower()).strip() + " "
        pattern = quote(rf"(?i)()(\b\Q{folded}\E{tail}\b)()")
        selects.append(
            f"SELECT doc_id, {i} AS pat, string_split(regexp_replace(f_plain, {pattern}, "
            f"{MARKED}, 'g'), chr(1)) AS parts FROM folded WHERE contains(f_words, {quote(words)})"
        )
    return f"{name}_m AS (\n  " + "\n  UNION ALL ".join(selects) + ")"


def spans(
    name: str,
    det: int,
    category: str,
    confidence: str,
    where: str = "true",
    left: int = 20,
    right: int = 20,
    around: bool = False,
    source: str | None = None,
    pat: str = "pat",
) -> str:
    a, b = ("lead_s", "stop") if around else ("s", "e")
    return f"""{name} AS (
  SELECT doc_id, s, e, '{category}' AS category, cast({confidence} AS DOUBLE) AS confidence, v AS value,
         {a} - {left} AS ctx_from, {b} + {right} AS ctx_to, {det} AS det, {pat} AS pat, seq
  FROM {source or name + '_v'} WHERE {where})"""


def before(width: int) -> str:
    return f"lower(substring(text, cast(greatest(s - {width}, 0) + 1 AS BIGINT), cast(s - greatest(s - {width}, 0) AS BIGINT)))"


def any_word(column: str, words: Sequence[str]) -> str:
    return f"len(list_filter([{quoted(words)}], lambda w: contains({column}, w))) > 0"


BSN = " + ".join(
    f"cast(substring(regexp_replace(v, '[^0-9]', '', 'g'), {i + 1}, 1) AS INTEGER) * ({w})"
    for i, w in enumerate(R.BSN_WEIGHTS)
)


def detector_ctes(name: str, det: int) -> list[str]:
    """CTEs ending in ``d_<name>`` with the spans of one detector."""
    d = f"d_{name}"
    if name == "emails":
        return [marked(d, R.EMAIL_RULES), positions(d), spans(d, det, "EMAIL", "0.99")]
    if name == "phones":
        return [marked(d, R.PHONE_RULES), positions(d), spans(d, det, "PHONE", "0.95")]
    if name == "ibans":
        return [
            marked(d, R.IBAN_RULES),
            positions(d),
            spans(d, det, "IBAN", "0.95", "NOT contains(v, 'XX') AND NOT contains(v, 'xx')"),
        ]
    if name == "birth_dates":
        return [
            marked(d, R.DATE_RULES),
            positions(d),
            spans(d, det, "DOB", "0.9", any_word(before(30), R.BIRTH_WORDS), left=30),
        ]
    if name == "addresses":
        return [
            marked(d, R.ADDRESS_RULES),
            positions(d),
            spans(d, det, "ADDRESS", "0.85", "NOT contains(v, chr(10))", left=30),
        ]
    if name == "national_ids":
        kinds: dict[str, list[str]] = {}
        for i, r in enumerate(R.ID_RULES):
            kinds.setdefault(r.kind, []).append(str(i))
        of = {k: f"pat IN ({', '.join(v)})" for k, v in kinds.items()}
        accept = f"""CASE WHEN {of['NL_BSN']} THEN ctx OR
              (length(regexp_replace(v, '[^0-9]', '', 'g')) = 9 AND ({BSN}) % 11 = 0)
            WHEN {of['US_SSN']} THEN ssn
            WHEN {of['BE_NATIONAL']} THEN ctx OR length(regexp_replace(v, '[-. ]', '', 'g')) <> 11
            WHEN {of['PASSPORT']} THEN ctx ELSE true END"""
        return [
            marked(d, R.ID_RULES),
            positions(d),
            f"""{d}_c AS (SELECT *, {any_word('bef', R.ID_WORDS)} AS ctx,
              {any_word('bef', R.SSN_WORDS)} AS ssn FROM (SELECT *, {before(50)} AS bef FROM {d}_v))""",
            spans(
                d, det, "ID", "CASE WHEN ctx THEN 0.85 ELSE 0.7 END", accept, left=30, source=f"{d}_c"
            ),
        ]
    if name == "roads":
        return [marked(d, R.ROAD_RULES), positions(d), spans(d, det, "ROAD", "0.95")]
    if name == "gazetteer_places":
        return [
            marked_names(d, R.KNOWN_PLACES),
            positions(d),
            spans(d, det, "PLACE", "0.95"),
        ]
    if name == "places":
        g, p = "d_gazetteer_places", "d_prep"
        return detector_ctes("gazetteer_places", det) + [
            marked(p, R.PREPOSITION_PLACE_RULES),
            positions(p),
            spans(
                p, det, "PLACE", "0.75",
                f"length(v) >= 3 AND lower(v) NOT IN ({quoted(R.ARTICLES)}) "
                f"AND v NOT IN ({quoted(R.KNOWN_PLACES)})",
                around=True, pat="1000 + pat",
            ),
            f"""{d} AS (SELECT {SPAN} FROM {g} UNION ALL SELECT {SPAN} FROM {p} a
              WHERE NOT EXISTS (FROM {g} b WHERE a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e))""",
        ]
    if name == "context_places":
        return [
            marked(d, R.CONTEXT_PLACE_RULES),
            positions(d),
            spans(
                d, det, "PLACE", "0.9",
                f"length(v) >= 3 AND v NOT IN ({quoted(R.CONTEXT_PLACE_STOPWORDS)})",
                left=10, right=10, around=True,
            ),
        ]
    if name == "named_streets":
        return [
            marked(d, R.NAMED_STREET_RULES),
            positions(d),
            spans(
                d, det, "STREET", "0.85",
                "length(v) >= 5 AND NOT contains(v, chr(10)) AND NOT "
                r"regexp_matches(substring(text, cast(e + 1 AS BIGINT), 10), '^\s*\d')",
            ),
        ]
    if name == "any_street":
        return [
            marked(d, R.ANY_STREET_RULES),
            positions(d),
            spans(
                d, det, "STREET", "0.88",
                f"length(v) >= 6 AND lower(v) NOT IN ({quoted(R.STREET_SUFFIXES)}) "
                f"AND lower(v) NOT IN ({quoted(R.NOT_STREETS)}) AND NOT suffix(lower(v), 'ering')",
            ),
        ]
    if name == "names":
        regions = " AND ".join(f"NOT contains(upper(v), '{w}')" for w in R.NAME_REGION_WORDS)
        return [
            marked(d, R.NAME_RULES),
            positions(d),
            spans(
                d, det, "PERSON", "0.8",
                f"length(v) >= 5 AND upper(v) NOT IN ({quoted(R.NAME_EXCLUSIONS)}) AND {regions} "
                f"AND list_last(regexp_split_to_array(lower(v), '\\s+')) NOT IN ({quoted(R.NAME_PLACE_ENDINGS)}) "
                "AND NOT contains(v, chr(10)) "
                f"AND NOT (pat = {R.CAPS_PAIR_RULE} AND regexp_matches(v, '^(?:EL|VAN|DE)\\s+"
                "(?:ERSTE|EERSTE|AANLEG|VLAANDEREN|NEDERLAND|FRANCE|GERMANY)'))",
                left=30,
            ),
        ]
    if name == "names_by_context":
        dated, caps, left = f"{d}_dated", f"{d}_caps", f"{d}_rest"
        return [
            marked(dated, [R.NAME_BEFORE_DATE_RULE]),
            positions(dated),
            spans(
                dated, det, "PERSON", "0.88",
                f"length(v) >= 3 AND lower(v) NOT IN ({quoted(R.NAME_BEFORE_DATE_STOPWORDS)})",
                left=10, right=30,
            ),
            marked(caps, [R.CAPS_NAME_RULE]),
            positions(caps),
            spans(
                caps, det, "PERSON", "0.85",
                f"v NOT IN ({quoted(R.CAPS_NAME_STOPWORDS)}) AND NOT EXISTS (FROM {dated} x "
                f"WHERE x.doc_id = {caps}_v.doc_id AND x.s < {caps}_v.e AND x.e > {caps}_v.s)",
                left=10, right=30, pat="1",
            ),
            marked(left, [R.NAME_BEFORE_PLACEHOLDER_RULE]),
            positions(left),
            spans(left, det, "PERSON", "0.82", "length(v) >= 4", left=10, right=30, pat="2"),
            f"""{d} AS (SELECT {SPAN} FROM {dated} UNION ALL SELECT {SPAN} FROM {caps}
              UNION ALL SELECT {SPAN} FROM {left} a WHERE NOT EXISTS (
                FROM (SELECT doc_id, s, e FROM {dated} UNION ALL SELECT doc_id, s, e FROM {caps}) b
                WHERE a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e))""",
        ]
    if name == "vehicle_brands":
        return [
            marked_names(d, R.VEHICLE_BRANDS, R.BRAND_TAIL),
            positions(d),
            spans(d, det, "VEHICLE", "0.92", "length(v) >= 3"),
        ]
    if name == "vehicle_models":
        return [
            marked_names(d, R.VEHICLE_MODELS),
            positions(d),
            spans(d, det, "VEHICLE", "0.88", pat="1000 + pat"),
        ]
    if name == "vehicles":
        b, m = "d_vehicle_brands", "d_vehicle_models"
        return (
            detector_ctes("vehicle_brands", det)
            + detector_ctes("vehicle_models", det)
            + [
                f"""{d} AS (SELECT {SPAN} FROM {b} UNION ALL SELECT {SPAN} FROM {m} x
                  WHERE NOT EXISTS (FROM {b} y WHERE x.doc_id = y.doc_id AND y.s < x.e AND y.e > x.s))"""
            ]
        )
    raise KeyError(name)


CORPUS = f"""docs AS MATERIALIZED (
  SELECT doc_id, text FROM documents
  UNION ALL SELECT c_custkey + {CASE_BASE} AS doc_id, {CASE_TEXT} AS text FROM customer)"""
CASES = f"""docs AS MATERIALIZED (
  SELECT c_custkey + {CASE_BASE} AS doc_id, {CASE_TEXT} AS text FROM customer)"""
DOCUMENTS = "docs AS MATERIALIZED (SELECT doc_id, text FROM documents)"


def joined_lines(column: str = "text") -> str:
    sql = column
    for p in R.LINE_JOIN_PARTICLES:
        sql = (
            rf"regexp_replace({sql}, '(^|[^\p{{L}}\p{{N}}_])({p})\n([A-Z][A-Za-z]+)', "
            rf"'\1\2 \3', 'g')"
        )
    return sql


PREPARED = f"prepared AS MATERIALIZED (SELECT doc_id, {joined_lines()} AS text FROM docs)"


def folded(source: str = "docs", name: str = "folded", text: str = "text") -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in FOLDS.items())
    return f"""{name} AS MATERIALIZED (
  SELECT *, ' ' || regexp_replace(lower(f_plain), '[^a-z0-9_]+', ' ', 'g') || ' ' AS f_words FROM (SELECT doc_id, text, {cols} FROM
    (SELECT doc_id, {text} AS text FROM {source})))"""


def detect(order: Sequence[str]) -> list[str]:
    ctes: list[str] = []
    for i, name in enumerate(order):
        ctes += detector_ctes(name, i)
    union = " UNION ALL ".join(f"SELECT {SPAN} FROM d_{name}" for name in order)
    return ctes + [f"cands AS MATERIALIZED ({union})"]


def resolve(source: str = "cands", where: str = "true") -> list[str]:
    """Greedy choice per document: ``kept(doc_id, s, e, category, confidence, value)``."""
    return [
        f"""ranked AS (
  SELECT doc_id, list(struct_pack(s := s, e := e, category := category, confidence := confidence,
      value := value, ctx_from := ctx_from, ctx_to := ctx_to)
      ORDER BY confidence DESC, e - s DESC, det, pat, seq) AS l
  FROM {source} GROUP BY doc_id),
kept AS MATERIALIZED (
  SELECT doc_id, u.s AS s, u.e AS e, u.category AS category, u.confidence AS confidence,
         u.value AS value, u.ctx_from AS ctx_from, u.ctx_to AS ctx_to
  FROM (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
          CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND k.e > x[1].s)) > 0
               THEN acc ELSE list_concat(acc, x) END)) AS u FROM ranked)
  WHERE {where})"""
    ]


UNMASKED = "NOT contains(u.value, 'XX') AND NOT contains(u.value, 'xx') AND NOT contains(u.value, '***')"


def key(value: str = "value", category: str = "category") -> str:
    up = f"upper(replace({value}, 'ß', 'SS'))"
    particles = quoted(R.NAME_KEY_PARTICLES)
    digits = f"regexp_replace({value}, '[^0-9+]', '', 'g')"
    return f"""CASE WHEN {category} = 'PERSON' THEN array_to_string(list_sort(list_filter(
        regexp_split_to_array({up}, '\\s+'), lambda w: w <> '' AND w NOT IN ({particles}))), '|')
      WHEN {category} = 'PHONE' THEN CASE
        WHEN starts_with({digits}, '00') THEN '+' || substring({digits}, 3)
        WHEN starts_with({digits}, '0') AND length({digits}) = 10 THEN '+32' || substring({digits}, 2)
        ELSE {digits} END
      WHEN {category} = 'IBAN' THEN regexp_replace({up}, '\\s', '', 'g')
      ELSE regexp_replace({up}, '^\\s+|\\s+$', '', 'g') END"""


def number(category: str, num: str) -> str:
    return f"{category} || '_' || CASE WHEN {num} < 1000 THEN lpad(cast({num} AS VARCHAR), 3, '0') ELSE cast({num} AS VARCHAR) END"


def entities(per_document: bool) -> list[str]:
    """``keyed`` spans and ``ents`` with number and placeholder per scope."""
    scope = "doc_id" if per_document else "0"
    part = "doc_id, " if per_document else ""
    return [
        f"keyed AS MATERIALIZED (SELECT *, {scope} AS scope, {key()} AS norm_key FROM kept)",
        f"""seen AS (SELECT *, row_number() OVER (PARTITION BY scope, norm_key ORDER BY doc_id, s DESC) AS nth,
      count(*) OVER (PARTITION BY scope, norm_key) AS occurrences FROM keyed)""",
        "vars AS (SELECT scope, norm_key, count(DISTINCT value) AS n_variations, "
        "array_to_string(list_sort(list(DISTINCT value)), '; ') AS variations FROM keyed GROUP BY ALL)",
        f"""firsts AS (SELECT scope, norm_key, category, value AS canonical, occurrences, doc_id, s,
      row_number() OVER (PARTITION BY {part}category ORDER BY doc_id, s DESC) AS num
      FROM seen WHERE nth = 1)""",
        f"""ents AS MATERIALIZED (SELECT scope, norm_key, category, canonical, occurrences, num,
      n_variations, variations, {number('category', 'num')} AS placeholder, doc_id AS first_doc, s AS first_s
      FROM firsts JOIN vars USING (scope, norm_key))""",
    ]


def rewritten(source: str, edits: str) -> str:
    """``edits(doc_id, s, e, repl)`` spliced into ``source(doc_id, text)``."""
    return f"""pieces AS (
  SELECT doc_id, s, e, repl, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM {edits}),
rewritten AS (
  SELECT d.doc_id, d.text, CASE WHEN p.body IS NULL THEN d.text
      ELSE p.body || substring(d.text, cast(p.last + 1 AS BIGINT)) END AS sanitized
  FROM {source} d LEFT JOIN (
    SELECT p.doc_id, string_agg(substring(t.text, cast(prev + 1 AS BIGINT), cast(s - prev AS BIGINT)) || repl, '' ORDER BY s) AS body,
           max(e) AS last
    FROM pieces p JOIN {source} t USING (doc_id) GROUP BY p.doc_id) p USING (doc_id))"""


def sql(ctes: Sequence[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def encoded(per_document: bool, order: Sequence[str], docs: str = CORPUS) -> list[str]:
    """Everything up to ``ents``: line joins, detection, masked filter, entities."""
    return (
        [docs, PREPARED, folded("prepared")]
        + detect(order)
        + resolve(where=UNMASKED)
        + entities(per_document)
    )


REPLACED = (
    "edits AS (SELECT k.doc_id, k.s, k.e, x.placeholder AS repl FROM keyed k JOIN ents x "
    "ON k.scope = x.scope AND k.norm_key = x.norm_key)"
)
