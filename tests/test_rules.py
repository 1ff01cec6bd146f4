"""Every rule on the JVM against the same pattern in Python's regex engine."""

import random
import re

from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.operators import detectors as D
from veilframe.operators import rules as R

FRAGMENTS = (
    "te in naar uit van bij richting vanuit via t.h.v. thv ter_hoogte_van Gent gent GENT Sint- "
    "Denis Saint- De Van El DE VAN EL DER LA La Le de du la von der zu Jean Marie François André "
    "Mc Mac O' Mr Mrs. Dr Prof. Willem Aya JANSEN JANSENS Küsten Café é É ñ ß ö straat laan weg "
    "Kamp Kampweg plein markt steenweg ring -weg ERSTE EERSTE Nationaliteit geboren Ingeboren "
    "PERSON_ PERSON_001 Grote Markt Koning rue avenue allée Street High Road - – / . , : ( ) + "
    "0 1 12 32 44 489 0489 12.34 66.70.88 123456782 1234 9000 75001 BE44 3770 AB X N133 e40 2001 "
    "a@b.co _foo@bar.com @ 01-02-2001 1/2/99 'x 's \n \n\n   \t 😀 ² e\u0301 Ⓐ ½x XX xx *** _ A Aa aA"
).split(" ")


def random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rnd.choice(FRAGMENTS).replace("_hoogte_", " hoogte ") for _ in range(rnd.randint(1, 40))]
        out.append("".join(w + rnd.choice([" ", " ", " ", "", "\n", "  "]) for w in words))
    return out


def all_rules():
    named = [(k, i, r) for k, v in vars(R).items() if k.endswith("_RULES") for i, r in enumerate(v)]
    return sorted(named, key=lambda x: (x[0], x[1]))


def python_hits(rule, text):
    flags = re.IGNORECASE if rule.ignore_case else 0
    pattern = re.compile(f"({rule.lead})({rule.value})({rule.trail})", flags)
    return [(m.start(1), m.start(2), m.end(2), m.end(3), m.group(2)) for m in pattern.finditer(text)]


def test_rules_match_as_in_python(spark, texts):
    values = random_texts(1000, 7)
    rules = [r for _, _, r in all_rules()]
    found = texts(*values).select(
        "doc_id", S.scannable(F.col("text")).alias("text")
    ).select("doc_id", F.expr(S.scan("text", rules)).alias("hits"))
    seen = {row.doc_id: row.hits for row in found.collect()}
    total = 0
    street = rules.index(R.ANY_STREET_RULES[0])
    for doc_id, text in enumerate(values):
        mine = {}
        for h in seen[doc_id]:
            mine.setdefault(h["rule"], []).append(
                (h["lead"], h["start"], h["end"], h["stop"], h["value"])
            )
        # After a hyphen the street rule may also yield a bare suffix, which the
        # detector drops like any other bare suffix; its lead is not part of a match.
        mine[street] = [
            (h[1], *h[1:])
            for h in mine.get(street, [])
            if h[4].lower() not in R.STREET_SUFFIXES
        ]
        for i, rule in enumerate(rules):
            expected = python_hits(rule, text)
            if i == street:
                expected = [h for h in expected if h[4].lower() not in R.STREET_SUFFIXES]
            total += len(expected)
            assert mine.get(i, []) == expected, (all_rules()[i][:2], text)
    assert total > 3000


def reference_context_names(text):
    """names_by_context spelled with plain patterns."""
    out, taken = [], []
    for lead, s, e, stop, v in python_hits(R.NAME_BEFORE_DATE_RULE, text):
        if len(v) >= 3 and v.lower() not in R.NAME_BEFORE_DATE_STOPWORDS:
            out.append((s, e, 0.88))
    taken = [(s, e) for s, e, _ in out]
    for lead, s, e, stop, v in python_hits(R.CAPS_NAME_RULE, text):
        if v not in R.CAPS_NAME_STOPWORDS and not any(s < b and e > a for a, b in taken):
            out.append((s, e, 0.85))
    for lead, s, e, stop, v in python_hits(R.NAME_BEFORE_PLACEHOLDER_RULE, text):
        if len(v) >= 4 and (s, e) not in [(a, b) for a, b, _ in out]:
            out.append((s, e, 0.82))
    return sorted(out)


def test_names_by_context_match_as_in_python(spark, texts):
    rnd = random.Random(3)
    words = (
        "JANSEN Piet Ab AbC van d'Or O-p A - – -x PERSON_001 PERSON_ geboren Nationaliteit Belg "
        "Ingeboren JANSENNationaliteit FOOPERSON_12 01-02-2001 3/4/1999 , . \n é Zé xY 9"
    ).split(" ")
    values = [
        "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "", "\n", "  "]) for _ in range(rnd.randint(2, 16)))
        for _ in range(1500)
    ]
    scanned = texts(*values).withColumn("text", S.scannable(F.col("text")))
    rows = scanned.select("doc_id", F.expr(D.names_by_context("text")).alias("spans")).collect()
    hits = 0
    for row in rows:
        mine = sorted((s["start"], s["end"], s["confidence"]) for s in row.spans)
        expected = reference_context_names(values[row.doc_id])
        hits += len(expected)
        assert mine == expected, values[row.doc_id]
    assert hits > 700


def test_gazetteer_equals_search_of_every_name(spark, texts):
    values = random_texts(300, 11) + ["Sint-Jans-Molenbeek en LIÈGE, x's-Gravenhage, La Louvière"]
    scanned = texts(*values).withColumn("text", S.scannable(F.col("text")))
    rows = scanned.select("doc_id", D.column(D.gazetteer_places, "text").alias("s")).collect()
    for row in rows:
        text = values[row.doc_id]
        expected = {
            (m.start(), m.end())
            for name in R.KNOWN_PLACES
            for m in re.finditer(r"\b" + re.escape(name) + r"\b", text, re.IGNORECASE)
        }
        assert {(x["start"], x["end"]) for x in row.s} == expected, text


def test_long_runs_do_not_exhaust_the_stack(spark, texts):
    long_name = "JANSEN " + "Willem " * 30_000
    values = [
        long_name + "- 01-02-2001",
        long_name + "geboren",
        "12 rue " + "Paix " * 30_000,
        "75001 Saint" + "-Denis" * 30_000,
        "Salu " * 30_000 + "PERSON_001",
        "a" * 100_000 + "@",
        "straat" * 20_000,
    ]
    rows = texts(*values).select("doc_id", D.detect("text", D.PATTERN_ORDER).alias("s")).collect()
    sizes = {r.doc_id: [(s["start"], s["end"]) for s in r.s if s["category"] == "PERSON"] for r in rows}
    assert (0, len(long_name) - 1) in sizes[0]
    assert (0, len(long_name) - 1) in sizes[1]
    assert (0, len("Salu " * 30_000) - 1) in sizes[4]


def test_first_class_of_patterns():
    """Patterns that begin with a word boundary are asked for their first character before."""
    assert R.first_class(r"\b\d{4}x") == r"\d"
    assert R.first_class(r"\bt\.?h") == "t"
    assert R.first_class(r"\b[A-Z]{2,}") == "[A-Z]"
    assert R.first_class(r"\b(?:von|zu|vom)\s") == "[vz]"
    assert R.first_class(r"\b(?:de\s+)?x") == R.first_class(r"\+?32") == R.first_class(r"a?b") == ""
    assert R.first_class(r"[a-z]*x") == R.first_class(r"(?:a|b)?c") == R.first_class(r"a{0,1}b") == ""
    rules = [r for t in vars(R).values() if isinstance(t, tuple) for r in t if isinstance(r, R.Rule)]
    bounded = [r for r in rules if (r.lead + r.value).startswith(r"\b") and not r.ignore_case]
    assert len(bounded) > 50 and all(r.jvm_regex().startswith("(?U)(?=") for r in bounded)


def test_named_streets_of_odd_words_equal_the_plain_pattern(spark):
    """Suffixes inside words, after one letter, twice, before marks, behind white space and ``de``."""
    rule = R.NAMED_STREET_RULES[0]
    words = ("Kerkstraat", "Kstraat", "Kestraatstraat", "Kerkstraate", "kerkstraat", "KErkplein", "Pléin",
             "Grotemarkt", "Grote Markt", "Grote Amarkt", "St.Kerklaan", "Ring", "Aring-weg", "Élaan", "Kaélaan")
    texts = [b + w + a for b in ("", "de ", "de  \n", "x", "x ", " ", "de", "Sint ", "de Oude\t") for w in words
             for a in ("", "1", "_", "é", "É", "-", " de Kapad")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, scan string")
    hits = rows.select("i", F.expr(S.scan("scan", [rule])).alias("hits")).collect()
    got = {r.i: [(h.start, h.end, h.value) for h in r.hits] for r in hits}
    want = {i: [(*m.span(), m.group()) for m in re.finditer(rule.value, t)] for i, t in enumerate(texts)}
    assert got == want
