import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing as M
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share the whole by weight; cap; share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


def test_query_follows_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes = Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    want = plain_targets(sizes)
    rows = QUERIES["op7_mixing"].run(spark, DATA).collect()
    assert {r.doc_id: r.size for r in rows} == words
    taken = Counter()
    for r in rows:
        rate = want[source[r.doc_id]] / sizes[source[r.doc_id]]
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (int(rate) * r.size, (int(rate) + 1) * r.size) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.1)
    again = QUERIES["op7_mixing"].run(spark, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 1}, {"a": 0, "b": 0}, {"ä": 3, "z": 90, "": 40, "B": 2}]
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s])


def test_mix_keeps_columns_and_odd_rows(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, None, None, 8), (2, "", "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    assert M.mix_documents(docs.where("false")).count() == 0


def test_draws_are_even(spark):
    got = spark.range(20_000).select(M.draw(F.col("id").cast("string")).alias("u"))
    low, high, mean = got.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01


def test_very_long_text(spark):
    long = "wörd \n" * 400_000
    rows = [(1, long, "x"), (2, "a b", "x"), (3, "c " * 300_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("source", M.count_words(F.col("text")).alias("size"))
    assert sorted(r.size for r in sized.collect()) == [2, 300_000, 400_000]
    want = plain_targets({"x": 400_002, "y": 300_000})
    assert {r.source: r.target for r in M.targets(sized).collect()} == pytest.approx(want)
    copies = Counter(r.doc_id for r in M.mix_documents(docs).where("text IS NOT NULL").collect())
    for i, source, size in ((1, "x", 400_002), (2, "x", 400_002), (3, "y", 300_000)):
        assert copies[i] in (int(want[source] / size), int(want[source] / size) + 1)
