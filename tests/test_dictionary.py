"""Names of a table against the searches of constant lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import dictionary as DI
from veilframe.operators import rules as R
from veilframe.plans import corpus as C

SF = "/root/testdata/sf0.001"


def table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def plain(texts, names, tail=""):
    """Places by one search for every name."""
    out = set()
    for k, text in texts:
        for name in {n.lower() for n in names}:
            for m in re.finditer(rf"\b{re.escape(name)}{tail}\b", text, re.I):
                out.add((k, m.start(), m.end(), m[0], name))
    return sorted(out)


@pytest.mark.parametrize("tail", ["", R.BRAND_TAIL])
def test_matches_one_search_a_name(spark, tail, monkeypatch):
    names = ["a b", "b a", "a", "a b a", "x-y", "Renault Trucks", "'s-Gravenhage", "St. Jan", "Été", "zzz", "A"]
    rng = random.Random(4)
    words = ["a", "b", "A", " ", " ", "  ", "\n", "-", "x-y", "renault", "TRUCKS", "x's-gravenhage", "'s-Gravenhage",
             "St. Jan", "été", "ab", "a_b", "9", ";", ".", "!", "T12-", "longer text here. "]
    texts = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    texts.append((60, "a b a b a b a; " * 3000))
    docs = spark.createDataFrame([*texts, (61, None)], "doc_id long, text string")
    got = DI.find_names(docs, table(spark, names), tail=tail).select("doc_id", "start", "end", "value", "name")
    assert sorted(map(tuple, got.collect())) == plain(texts, names, tail)
    monkeypatch.setattr(DI, "BROADCAST_BYTES", -1)
    again = DI.find_names(docs, table(spark, names), tail=tail)
    assert again.count() == len(plain(texts, names, tail))


def test_many_names(spark):
    """A hundred thousand names beside the built-in ones find what those find, and more."""
    docs = C.case_files(spark, SF)
    own = table(spark, R.KNOWN_PLACES)
    many = spark.range(100_000).select(F.concat(F.lit("Zz"), F.col("id").cast("string"), F.lit(" de Place")).alias("name"))
    a = DI.find_names(docs, own).select("doc_id", "start", "end", "name")
    b = DI.find_names(docs, own.unionByName(many).unionByName(table(spark, ["stationstraat"])))
    b = b.select("doc_id", "start", "end", "name")
    extra = b.where("name = 'stationstraat'").count()
    assert extra > 0 and b.where("name <> 'stationstraat'").exceptAll(a).count() == 0
    assert b.count() == a.count() + extra


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Gent"), (1, "Gent"), (None, "te gent")], "doc_id long, text string")
    got = DI.find_names(docs, table(spark, ["Gent", "gent", None, "--", ""])).collect()
    assert sorted((str(r.doc_id), r.start, r.end, r.value) for r in got) == [
        ("1", 0, 4, "Gent"), ("1", 0, 4, "Gent"), ("None", 3, 7, "gent")
    ]
    assert DI.find_names(docs, table(spark, [])).collect() == []
    assert DI.find_names(docs.where("false"), table(spark, ["Gent"])).collect() == []
    with pytest.raises(Exception, match="barrier"):
        DI.find_names(docs, table(spark, ["Gent; Brugge"])).collect()


def test_words_are_placed_without_a_fold_over_tokens(spark):
    """Before, places were sums of lengths, by folds that Spark evaluates token by token."""
    df = spark.createDataFrame([("Sint-Jans  Ée x_1 \U0001f600 GENT",), ("",), (None,), (" - ",)], "t string")
    placed = df.select(DI.words_at(F.col("t")).alias("w"))
    assert "aggregate(" not in placed._jdf.queryExecution().optimizedPlan().toString()
    rows = [[(w.word, w.at) for w in r.w or []] for r in placed.collect()]
    assert rows == [[("sint", 0), ("jans", 5), ("ée", 11), ("x_1", 14), ("gent", 20)], [], [], []]
