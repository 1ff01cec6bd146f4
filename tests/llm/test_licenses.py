import random
import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from veilframe.llm import licenses as L
from veilframe.llm.license_rules import FAMILIES, rules
from veilframe.llm.license_texts import EXCEPTIONS, NEGATIVES, SIGNATURES
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
PHRASES = {
    "mit": "under the mit license".split(),
    "apache-2": "apache license version 2".split(),
    "cc-by-nc": "cc by nc".split(),
}


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label)
        for label, phrase in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase)] == phrase
    ]
    return len(words), places


def check(r, text):
    n, places = plain_base(text)
    at = [i for i, _ in places]
    assert (r.n_words, r.n_base) == (n, len(places))
    assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
    assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert r.labels.split(",") == sorted(set(r.labels.split(",")))
    assert 0 <= r.score <= 1


EVERY = rules()


def plain_detections(low):
    """All rules, without keywords; each in its order, unless inside an accepted one."""
    found = [
        (m.start(), m.end(), rule, L.label_of(rule, m)) for rule in EVERY for m in rule.pattern.finditer(low)
    ]
    found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[3] or ""))
    kept = []
    for f in found:
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    return [f for f in kept if f[3] is not None]


def test_labels_and_scores_match_all_rules_on_whole_texts(spark):
    """Every document of the smallest table against every rule, texts in full."""
    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_licenses"].run(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        low = text.encode().lower().decode()
        kept = plain_detections(low)
        base = {label for _, label in plain_base(text)[1]}
        assert r.labels == ",".join(sorted(base | {f[3] for f in kept}))
        assert r.score == max([1.0] * bool(base) + [f[2].score for f in kept], default=0.0)


def sample(items, rng):
    """A text that a parsed pattern matches; a gap is one character."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "y"
        elif name == "IN":
            out += one_of(arg, rng)
        elif name == "MAX_REPEAT":
            low, high, body = arg
            times = rng.randint(low, min(high, low + 1))
            out += "".join(sample(body, rng) for _ in range(times))
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        else:
            assert name in ("ASSERT", "ASSERT_NOT", "AT"), name
    return out


def one_of(choices, rng):
    if str(choices[0][0]) == "NEGATE":
        return " "
    op, arg = rng.choice(choices)
    return {"LITERAL": lambda: chr(arg), "RANGE": lambda: chr(rng.randint(*arg)), "CATEGORY": lambda: " "}[str(op)]()


def test_keywords_are_in_all_that_a_signature_matches():
    rng = random.Random(5)
    mine = [r for r in rules() if r.kind in ("signature", "exception", "negative")]
    assert len(mine) == len(SIGNATURES) + len(EXCEPTIONS) + len(NEGATIVES)
    for rule in mine:
        matched = 0
        for _ in range(60):
            text = sample(parser.parse(rule.pattern.pattern), rng)
            m = rule.pattern.search(text)
            if m:
                matched += 1
                assert rule.keyword in m.group(), (rule, text)
        assert matched, rule


def test_query_matches_loops(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op5_licenses"].run(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


TEXTS = [
    None,
    "",
    "Under the MIT-license, and under\nthe mit (license); Under the MIT LICENSE" + " word" * 30_000 + " under the mit license",
    "apache license version 2.0 apache license version 20 xapache license version 2",
    "CC-BY-NC 4.0 cc by nc sa; ccbync; éunder the mit license",
    "Licensed under the GNU Lesser General Public License, version 2.1",
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, labels string")
    rows = docs.select("doc_id", L.licenses(F.col("text")).alias("f")).select("doc_id", "f.*").collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        check(r, TEXTS[r.doc_id])
    assert docs.where("false").select(L.licenses(F.col("text"))).count() == 0


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner()


def found(scanner, text):
    return [(label, rule.kind) for *_, rule, label in scanner.detections(text.lower())]


def test_hundreds_of_rules_and_no_keyword_hides_a_match():
    every = rules()
    assert len(every) > 450
    for label, title, identifier, address in FAMILIES:
        text = f"{title}; spdx-license-identifier: {identifier}; {address}".lower()
        kinds = {r.kind for r in every if r.label == label and r.keyword in text and r.pattern.search(text)}
        assert {"title", "identifier", "address"} <= kinds, label


def test_suppression(scanner):
    text = "Licensed under the GNU Lesser General Public License, version 2.1 or, GNU General Public License"
    assert found(scanner, text) == [("lgpl-2.1", "grant"), ("gpl", "title")]
    assert found(scanner, "SPDX-License-Identifier: Apache-2.0") == [("apache-2", "identifier")]
    assert found(scanner, "released under CC BY-NC-SA 4.0 terms") == [("cc-by-nc-sa", "short")]
    assert found(scanner, "permission granted, no license meant; mit der apache") == []


def test_exceptions_and_negatives(scanner):
    text = "GPL v2 with the Classpath Exception. This file is not licensed under the Apache License 2.0; GNU GPL v3 or later."
    assert found(scanner, text) == [
        ("gpl-2", "signature"), ("classpath-exception", "exception"), ("gpl-3-plus", "signature")
    ]
    assert found(scanner, "not to be confused with the MIT License") == []
    assert found(scanner, "either version 2 of the License, or (at your option) any later version") == [
        ("gpl-2-plus", "signature")
    ]


def test_containment_matches_loops():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 30) for _ in range(12))]
        plain = []
        for s in spans:
            if not any(p[0] <= s[0] and s[1] <= p[1] for p in plain):
                plain.append(s)
        assert list(L.uncontained(spans)) == plain
