import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.arrays import explode_structs, let
from veilframe.functions.rewrite import splice
from veilframe.operators import detectors as D
from veilframe.operators.rules import Rule

SCHEMA = f"doc_id long, spans array<{S.SPAN_TYPE}>"


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], -(s[1] - s[0]))):
        if not any(s[0] < k[1] and s[1] > k[0] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[0])


def random_spans(rnd):
    out = []
    for _ in range(rnd.randint(0, 40)):
        a = rnd.randint(0, 80)
        out.append((a, a + rnd.randint(1, 15), "C", rnd.choice([0.8, 0.85, 0.9]), "v", 0, 0))
    return out


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, random_spans(rnd)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df.select("doc_id", S.resolve_overlaps(F.col("spans")).alias("k")).collect()
    for r in kept:
        mine = [(s["start"], s["end"], s["confidence"]) for s in r.k]
        assert mine == [(s[0], s[1], s[3]) for s in greedy(rows[r.doc_id][1])]


def test_first_per_place_keeps_list_order(spark):
    spans = [(5, 9, "A", 0.8, "x", 0, 0), (1, 2, "B", 0.8, "x", 0, 0), (5, 9, "C", 0.9, "x", 0, 0)]
    df = spark.createDataFrame([(0, spans)], SCHEMA)
    row = df.select(S.first_per_place(F.col("spans")).alias("k")).first()
    assert [s["category"] for s in row.k] == ["A", "B"]


def test_keep_free_and_without(spark):
    a = [(0, 5, "A", 0.8, "x", 0, 0), (4, 8, "A", 0.8, "x", 0, 0), (20, 25, "A", 0.8, "x", 0, 0)]
    b = [(22, 23, "B", 0.8, "x", 0, 0)]
    df = spark.createDataFrame([(a, b)], f"a array<{S.SPAN_TYPE}>, b array<{S.SPAN_TYPE}>")
    row = df.select(
        S.keep_free(F.col("a"), F.col("b")).alias("free"),
        S.without(F.col("a"), F.col("b"), S.overlaps).alias("rest"),
    ).first()
    assert [s["start"] for s in row.free] == [0]
    assert [s["start"] for s in row.rest] == [0, 4]


def test_offsets_count_code_points(spark, texts):
    text = "😀é x@y.com\u0001 😀 N133"
    df = texts(text).withColumn("scan", S.scannable(F.col("text")))
    spans = df.select(S.resolve_overlaps(D.detect("scan")).alias("s")).first().s
    assert [(s["value"], text[s["start"]:s["end"]]) for s in spans] == [
        ("x@y.com", "x@y.com"),
        ("N133", "N133"),
    ]


def test_splice(spark, texts):
    edit = "struct<start:int,end:int,replacement:string>"
    df = spark.createDataFrame(
        [("ab😀cdef", [(0, 1, "XX"), (2, 4, "")]), ("abc", []), ("abc", None)],
        f"text string, e array<{edit}>",
    )
    assert [r[0] for r in df.select(splice(F.col("text"), F.col("e"))).collect()] == [
        "XXbdef", "abc", "abc"
    ]


def test_explode_skips_empty_arrays(spark, texts):
    df = texts("x@y.com", "nothing", None).withColumn("spans", D.detect("text", ["emails"]))
    assert explode_structs(df, ["doc_id"], "spans").count() == 1


def test_category_filter(spark, texts):
    df = texts("x@y.com te Gent").withColumn("spans", S.resolve_overlaps(D.detect("text")))
    kept = df.select(S.in_categories(F.col("spans"), ["PLACE"], 0.5).alias("s")).first().s
    assert [s["value"] for s in kept] == ["Gent"]


def test_snippet_is_clipped(spark, texts):
    df = texts("abc x@y.com def")
    spans = df.withColumn("s", D.detect("text", ["emails"])).select(
        S.snippet(F.col("text"), F.col("s")[0]["ctx_from"], F.col("s")[0]["ctx_to"])
    )
    assert spans.first()[0] == "abc x@y.com def"


def test_binding_copies_nothing(spark):
    """A transform copies what its body gives, with all strings in it, at every level."""
    plan = spark.range(1).select(
        let(F.concat(F.col("id").cast("string"), F.lit("x")), lambda v: F.concat(v, v)).alias("a"),
        F.expr(S.bind("cast(id AS string)", "v", "concat(v, v)")).alias("b"),
    )
    assert "transform(" not in plan._jdf.queryExecution().analyzed().toString()
    assert plan.first() == ("0x0x", "00")


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 255, 256, 257, 513])
def test_hits_with_and_without_groups(spark, n):
    """Places are those of Python's search, around the borders of stretches."""
    plain, grouped = Rule(r"\d+"), Rule(lead="[a-z]+", value=r"\d", trail=r"\d*")
    text = "".join(f"{'é' * (i % 3)}ab{i} " for i in range(n))
    whole = [(m.start(), m.end()) for m in re.finditer(plain.value, text)]
    value = [m.span(1) for m in re.finditer(r"[a-z]+(\d)\d*", text)]
    frame = spark.createDataFrame([(text,)], "t string")

    def found(rules):
        hits = frame.select(F.expr(S.scan("t", rules)).alias("h")).first().h
        assert all(text[h.start : h.end] == h.value for h in hits)
        return [[(h.start, h.end) for h in hits if h.rule == i] for i in range(len(rules))]

    assert found([plain]) == [whole]
    assert found([grouped]) == [value]
    assert found([plain, grouped, plain]) == [whole, value, whole]
