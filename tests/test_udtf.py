"""Models as table functions of SQL."""

from __future__ import annotations

from veilframe.operators import external as X
from veilframe.operators import pages as P


def test_a_model_sees_chunks_and_finds_places_in_whole_texts(spark, texts):
    def load():
        def predict(text):
            assert len(text) <= 40
            at = [i for i, c in enumerate(text) if c == "X"]
            return [{"start": i, "end": i + 1, "label": "PER", "score": 0.5} for i in at]

        return predict

    X.register_model(spark, "marks", load)
    long = "\n\n".join(f"deel {i} met X en é😀 X" for i in range(200))
    docs = texts(long, None, "", "geen", "X")
    P.paragraph_chunks(docs, 40).createOrReplaceTempView("udtf_chunks")
    found = spark.sql(
        "SELECT c.doc_id, m.* FROM udtf_chunks c, LATERAL marks(c.text, c.chunk_start) m"
    )
    want = {(0, i) for i, c in enumerate(long) if c == "X"} | {(4, 0)}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.doc_id, r.start) for r in rows} == want
    assert {(r.end - r.start, r.label, r.score, r.lang) for r in rows} == {(1, "PER", 0.5, None)}
    assert spark.sql("SELECT * FROM marks('aX', null)").first().start == 1
    # The rows are spans that documents can be joined with.
    assert X.attach_external(docs, found).where("size(external) > 0").count() == 2


def test_a_model_runs_once_over_each_text(spark, texts):
    """The checks and the join read the spans that one run of the model found."""
    runs = spark.sparkContext.accumulator(0)

    def predict(row):
        runs.add(1)
        return row.doc_id, 0, 4, "PER", 0.9, "nl"

    docs = texts("Anna gaat", "Bert komt", "Cees ziet").repartition(2)
    schema = "doc_id long, start int, end int, label string, score double, lang string"
    found = spark.createDataFrame(docs.rdd.map(predict), schema)
    assert X.attach_external(docs, found).where("size(external) = 1").count() == 3
    assert runs.value == 3
