"""Hits found word by word in Python against one expression a rule on the JVM."""

import time

import pytest
from pyspark.sql import functions as F
from test_rules import random_texts

from veilframe.functions import spans as S
from veilframe.functions.search import _ODD_CASE, Searches
from veilframe.operators import detectors as D
from veilframe.operators import rules as R
from veilframe.operators.encode import detect_spans

ODD = [
    None, "", "FIAT Ducato, KİA, Meſsen ı Brügge", "ſtraat Kampweg KAMPWEG kampſtraat", "a@b.co+c@d.org,@x.yz e@f.ghi",
    "te\x1cGent te\x1dBreda x\x1f01-02-2001", "'s-Gravenhage x's-Gravenhage in Den  Haag, Den Haag en den haag",
    "Jan Jansen - 01/02/1999-03/04/2000 - 05-06-2007", "x-straat-weg -weg a-Kampweg-b _Kampweg Kampweg1",
    "Mika Toru PERSON_0012 Vana PERSON_10000 Ab Cd PERSON_123", "٣٤٥٦٧٨٩٠١ BE44377012345678",
    "É KAMPWEG, Kampdij\u212a, \u212aampstraat, \u212aLEIN Ann geboren, te \u212aeulen, \u212anokke-Heist, \u212aia Rio en opel",
]


@pytest.mark.parametrize("order", [D.PATTERN_ORDER, D.HYBRID_ORDER])
def test_hits_in_one_pass_give_the_spans_of_one_pass_a_rule(texts, order):
    seen = texts(*random_texts(1500, 11), *ODD).withColumn("scan", S.scannable(F.col("text")))
    found = seen.withColumn("hits", D.hits("scan", order)).select(
        "text", D.detect("scan", order).alias("want"), D.detect("scan", order, "hits").alias("got")
    )
    rows = found.collect()
    assert sum(len(r.want) for r in rows) > 3000
    assert [(r.text, r.got) for r in rows if r.got != r.want] == []


@pytest.mark.parametrize("order", [D.PATTERN_ORDER, D.HYBRID_ORDER])
def test_spans_chosen_in_one_pass_are_those_of_the_expression(texts, order):
    seen = texts(*random_texts(800, 12), *ODD).withColumn("scan", S.scannable(F.col("text")))
    found = seen.withColumn("hits", D.hits("scan", order)).select(
        "text", S.resolve_overlaps(F.col("hits")).alias("want"), D.hits("scan", order, resolve=True).alias("got")
    )
    rows = found.collect()
    assert sum(len(r.want) for r in rows) > 1000
    assert [(r.text, r.got) for r in rows if r.got != r.want] == []


def test_conditions_and_choice_are_no_expressions_of_the_plan(texts):
    """Before, each hit went to the JVM and through some 60 lambda functions there."""
    plan = detect_spans(texts("te Gent"), "hybrid")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") < 5


def test_a_capital_k_is_no_odd_letter():
    """Before, it had every text beyond ASCII searched as a whole."""
    assert not _ODD_CASE.search("KLEIN in Liège") and all(_ODD_CASE.search(c) for c in "\u017f\u212a\u0131\u0130")


def test_detection_does_not_walk_a_text_once_a_rule(texts):
    """Before, the plan of detection replaced in every text some 200 times over."""
    plan = detect_spans(texts("te Gent"), "patterns")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert plan.count("regexp_replace") < 20


def test_search_of_long_texts_grows_like_the_text():
    searches = Searches(D.RULE_SETS, D.NAME_SETS)
    made = (
        lambda n: "JANSEN " + "Willem " * n + "- 01-02-2001", lambda n: "12 rue " + "Paix " * n,
        lambda n: "Salu " * n + "PERSON_001", lambda n: "a" * 4 * n + "@", lambda n: "straat" * n,
        lambda n: "@" * n, lambda n: "-straat" * n, lambda n: "Kampweg " * n, lambda n: "1 " * n, lambda n: "te Gent " * n,
    )
    for make in made:
        short, long = make(2_000), make(40_000)
        searches.hits(short)
        started = time.perf_counter()
        searches.hits(long)
        assert time.perf_counter() - started < 5, long[:20]


def test_first_word_of_patterns():
    assert R.first_word(r"\b\d{4}\s?x") == r"\d{4}"
    assert R.first_word(r"\b\d{4} x") == R.first_word(r"\b\d{4}[ ]+x") == r"\d{4}$"
    assert R.first_word(r"\b[A-Z]{2}\d?x") == "[A-Z]{2}"
    assert R.first_word(r"\b(?:von|zu)\s+(?:der\s+)?x") == "(?:von|zu)$"
    assert R.first_word(r"\b(?:de\s+)?x") is R.first_word(r"\+?32") is None
