"""Texts scanned in pieces against texts scanned whole."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import pieces as PC
from veilframe.operators import rules as R
from veilframe.operators.encode import detect_spans, encode, encode_corpus, encode_large, spans_in_pieces
from veilframe.plans import corpus as C

SF = "/root/testdata/sf0.001"


def all_rules():
    for name, value in vars(R).items():
        if isinstance(value, R.Rule):
            yield name, value
        elif isinstance(value, tuple):
            yield from ((name, v) for v in value if isinstance(v, R.Rule))


def all_names():
    for name in ("KNOWN_PLACES", "VEHICLE_BRANDS", "VEHICLE_MODELS"):
        yield from getattr(R, name)


def test_no_rule_can_match_a_barrier():
    """No pattern spells a barrier character, and none has a class that would hold any."""
    signs = set(';:!"[]{}<>=|#&$*\\')
    for name, rule in all_rules():
        for pattern in (rule.lead, rule.value, rule.trail, rule.jvm or "", rule.jvm_lead):
            plain = re.sub(r"\(\?(?:[a-z-]*[:=!>]|<[=!])", "(", pattern)  # group heads
            plain = re.sub(r"\\[bsSdwpZzQE]|\\.", lambda m: "" if m[0][1].isalnum() else m[0][1], plain)
            plain = re.sub(r"\{\d+,?\d*\}", "", plain)
            assert "[^" not in plain, (name, pattern)
            assert "." not in re.sub(r"\\\.", "", re.sub(r"\[[^\]]*\]", "", pattern)), (name, pattern)
            inside = "".join(re.findall(r"\[([^\]]*)\]", plain))
            assert not signs & set(inside), (name, pattern)
            outside = re.sub(r"\[[^\]]*\]|[|?*()+]", "", plain)
            assert not signs & set(outside), (name, pattern)
    for n in all_names():
        assert not re.search(PC.BARRIER, n + " "), n


def case_text(spark, n):
    files = C.case_files(spark, SF).where(F.col("doc_id") < C.CASE_BASE + n)
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return files.agg(F.array_join(parts["text"], "\n").alias("text"))


@pytest.mark.parametrize("backend,size", [("patterns", 1000), ("hybrid", 150)])
def test_spans_of_pieces_are_those_of_the_whole(spark, backend, size):
    odd = ["", None, "Mr. Jan Peeters. " * 40, "geboren op" + " " * 200 + "01/02/1980; " * 30, "x" * 2000,
           "geboren op: " * 30 + "01/02/1980", "é😀; te Gent! " * 60, "DE GROOT Jan - 01-02-1980\n" * 30]
    texts = case_text(spark, 25).unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    docs = texts.withColumn("k", F.monotonically_increasing_id()).cache()
    whole = detect_spans(docs, backend).select("k", F.inline("spans"))
    parts = spans_in_pieces(docs, ["k"], backend, False, size).select("k", F.inline("spans"))
    order = lambda df: sorted(tuple(r) for r in df.collect())
    a, b = order(whole), order(parts)
    assert len(a) > 300 and a == b


def test_pieces_cover_the_text(spark):
    text = case_text(spark, 20).first().text
    docs = spark.createDataFrame([(1, text), (2, "a" * 5000), (3, "")], "k long, text string")
    rows = PC.piece_rows(docs, ["k"], 300).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.k, r.piece)):
        assert r.begin == len(got.get(r.k, ""))
        assert r.shown == (0 if r.piece == 0 else PC.LOOK_BACK)
        got[r.k] = got.get(r.k, "") + r.text[r.shown :]
    assert got == {1: text, 2: "a" * 5000}
    assert sum(r.k == 1 for r in rows) > 20 and sum(r.k == 2 for r in rows) == 1


def test_large_texts_encode_as_whole_ones(spark):
    text = case_text(spark, 60).first().text
    rows = [(1, text), (1, text[:30_000]), (None, "Mail user1@example.com"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r.doc_id), str(r.text), str(r.sanitized), str(r.mapping))
    a = sorted(map(key, encode(docs).select("doc_id", "text", "sanitized", "mapping").collect()))
    b = sorted(map(key, encode_large(docs, piece=2000).select("doc_id", "text", "sanitized", "mapping").collect()))
    assert a == b and len(a) == 5


def test_spans_of_large_texts_do_not_pass_the_driver(spark):
    """However small the files are that they are estimated by."""
    plan = encode_large(case_text(spark, 60), piece=2000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_corpus_with_a_large_text(spark):
    text = case_text(spark, 60).first().text
    docs = spark.createDataFrame([(1, text), (2, "Mail user1@example.com")], "doc_id long, text string")
    encoded = encode_corpus(docs)
    (alone,) = encode_corpus(docs.where("doc_id = 1")).documents.collect()
    rows = {r.doc_id: r.sanitized for r in encoded.documents.collect()}
    assert rows[1] == alone.sanitized and "EMAIL_" in rows[2]
    (own,) = encode(docs.where("doc_id = 1"), backend="hybrid").collect()
    # The same spans are replaced, whatever their numbers.
    cut = lambda t: re.sub(r"_\d{3,}", "", t)
    assert cut(rows[1]) == cut(own.sanitized)


def test_edits_meet_their_pieces(spark):
    text = "one: two; three! four? " * 400
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, text + "!")], "k long, text string")
    edits = [(1, m.start(), m.end(), m[0].upper()) for m in re.finditer("two|four", text)]
    edits += [(3, 0, 3, ""), (3, len(text), len(text) + 1, "END")]
    frame = spark.createDataFrame(edits, "k long, start int, end int, replacement string")
    rows = PC.piece_rows(docs, ["k"], 200)
    got = {r.k: r.sanitized for r in PC.spliced(rows, ["k"], frame).collect()}
    want = {1: re.sub("two|four", lambda m: m[0].upper(), text), 2: "x", 3: text[3:] + "END"}
    assert got == want
