"""The input texts of the registered queries."""

import re

from pyspark.sql import functions as F

from veilframe.functions.text import join_broken_names
from veilframe.operators import encode as EN
from veilframe.operators.rules import LINE_JOIN_PARTICLES
from veilframe.plans import corpus as C
from veilframe.plans.queries import corpus_stream

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_is_documents_and_case_files(spark):
    whole = C.corpus(spark, SF)
    parts = C.documents(spark, SF).unionByName(C.case_files(spark, SF))
    assert whole.schema == parts.schema
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_detection_stands_once_in_a_plan(spark):
    found = EN.prepared_spans(C.corpus(spark, SF), "hybrid", None, True)
    assert plan_of(found).count("burgerservicenummer") == 1


def test_streamed_files_are_dealt_out(spark):
    """A small file is one split: without this one task writes and encodes all case files."""
    assert "Repartition" in corpus_stream(spark, SF)._jdf.logicalPlan().toString()


def test_lines_are_joined_as_one_particle_after_another(spark, texts):
    def one_by_one(text):
        for particle in LINE_JOIN_PARTICLES:
            text = re.sub(rf"\b({particle})\n([A-Z][A-Za-z]+)", r"\1 \2", text)
        return text

    values = [
        "VAN\nDER\nBerg", "DE\nDE\nBoer", "VAN\nDE\nDE\nBoer", "DE\nDER\nBerg\nDE\nB", "DE\nB", "xDE\nBoer", "DE\nboer",
        "TEN\nTEN\nTEN\nHove", "LA\nÉcole", "LE\nAbé DE\nWit", "DE\n\nBoer", "", "EL\nEL",
    ]
    rows = texts(*values).withColumn("text", join_broken_names(F.col("text"))).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [one_by_one(v) for v in values]
