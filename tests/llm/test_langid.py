import math

import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid as L
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain_sum(word, probability):
    """Over all ways to cut the word."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        p = probability.get(word[:j], L.UNKNOWN if j == 1 else 0.0)
        if p:
            total += p * plain_sum(word[j:], probability)
    return total


def test_forward_and_expected_counts():
    p = {"a": 0.2, "b": 0.1, "ab": 0.3, "▁": 0.05, "▁a": 0.15, "ba": 0.2}
    word = "▁abbaab"
    (got,) = L.log_likelihoods([word[1:]], L.Model(("x", "y"), {k: (v, v / 2) for k, v in p.items()}))
    assert got[0] == pytest.approx(math.log(plain_sum(word, p)))
    assert got[1] == pytest.approx(math.log(plain_sum(word, {k: v / 2 for k, v in p.items()})))
    counts = L.expected_counts(word[1:], p, 2)
    many = [word[1:], "b", "zab", "ab", "aabb"]
    for w, line in zip(many, L.log_likelihoods(many, L.Model(("x",), {k: (v,) for k, v in p.items()}))):
        assert line[0] == pytest.approx(math.log(plain_sum("▁" + w, p)))
    assert sum(len(k) * v for k, v in counts.items()) == pytest.approx(len(word))
    step = 1e-6  # the expected count is the slope of the log-likelihood
    for piece in p:
        more = plain_sum(word, p | {piece: p[piece] * (1 + step)})
        assert counts.get(piece, 0.0) == pytest.approx((math.log(more) - got[0]) / step, abs=1e-3)


def plain_log(word, probability, longest):
    """Logarithm of the same sum, place by place, in logarithms."""
    word = L.START + word
    ahead = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(max(0, j - longest), j):
            p = probability.get(word[i:j], L.UNKNOWN if j == i + 1 else 0.0)
            if p:
                ways.append(ahead[i] + math.log(p))
        top = max(ways)
        ahead[j] = top + math.log(sum(math.exp(w - top) for w in ways))
    return ahead[-1]


def test_long_words_are_summed_whole():
    p = {"a": 0.2, "b": 1e-7, "ab": 0.3, "▁": 0.05, "aab": 0.2, "cababcab": 1e-9}
    model = L.Model(("x", "y"), {k: (v, v / 3) for k, v in p.items()})
    for word in ("z" * 500, "abcab" * 40, "aab" * 11, "cababcab" * 300, "é" * 17, "b" * 2000):
        (line,) = L.log_likelihoods([word], model)
        assert line[0] == pytest.approx(plain_log(word, p, 8), rel=1e-9)
        assert line[1] == pytest.approx(plain_log(word, {k: v / 3 for k, v in p.items()}, 8), rel=1e-9)
        counts = L.expected_counts(word, p, 8)
        assert sum(len(k) * v for k, v in counts.items()) == pytest.approx(len(word) + 1)
    (line,) = L.log_likelihoods(["b" * 30_000], model)
    assert math.isfinite(line[0])


def test_query_matches_plain_sums(spark):
    """Every prediction over the whole table, by sums of one word after another."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    model = L.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    tables = [{p: v[i] for p, v in model.pieces.items()} for i in range(len(model.languages))]
    known = {}
    got = {r.doc_id: r for r in QUERIES["op6_language"].run(spark, folder).collect()}
    for r in docs.collect():
        sums = [0.0] * len(tables)
        words = L.LETTERS.findall((r.text or "").lower())
        for w in words:
            if w not in known:
                known[w] = [plain_log(w, t, model.longest) for t in tables]
            sums = [a + b for a, b in zip(sums, known[w])]
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        best = max(range(len(sums)), key=lambda i: sums[i])
        assert got[r.doc_id].lang_pred == model.languages[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums), abs=1e-6)


def test_query_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = QUERIES["op6_language"].run(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.25 < len(held) / len(rows) < 0.42
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "en", "the house and the tree " * 3) for i in range(40)]
    rows += [(100 + i, "de", "das haus und der baum " * 3) for i in range(40)]
    rows += [(None, "xx", "never learned"), (7000, None, "unlabelled text"), (1, "en", "the house")] * 2
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(labelled.where("doc_id IS NOT NULL"))
    assert model.languages == ("de", "en")
    texts = [None, "", "12 34 -- !", "the tree", "und der baum", "x" * 5000, "日本語 " * 40, "ﬀ İ"]
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] * 2, "doc_id int, text string, score double")
    got = asked.select("doc_id", L.predicted(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    by = {r.doc_id: (r.lang, r.score) for r in got}
    assert by[0] == by[1] == by[2] == ("und", 0.0)
    assert (by[3][0], by[4][0]) == ("en", "de")
    assert all(0 <= s <= 1 for _, s in by.values())
    empty = L.fit(labelled.where("false"))
    assert empty.languages == ()
    none = asked.select(L.predicted(F.col("text"), empty).alias("p")).select("p.*").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]
