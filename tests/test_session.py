"""Scratch tables live as long as the job that made them."""

from pathlib import Path

import pytest

from veilframe.operators.encode import encode_corpus
from veilframe.session import own_scratch, pin_rows
from veilframe.streaming.encode import encode_batches


def scratch(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {p.name for p in Path(folder).iterdir() if p.name.startswith("pinned-")}


def test_only_own_tables_go(spark, texts):
    docs = texts("Mr. Jan Peeters", "jan@example.com", None)
    before = pin_rows(docs)
    kept = scratch(spark)
    with own_scratch(spark):
        outer = pin_rows(docs)
        with own_scratch(spark):
            assert pin_rows(docs).count() == 3
            assert len(scratch(spark)) == len(kept) + 2
        assert outer.count() == 3 and len(scratch(spark)) == len(kept) + 1
    assert scratch(spark) == kept and before.count() == 3
    with pytest.raises(ZeroDivisionError), own_scratch(spark):
        pin_rows(docs)
        1 / 0
    assert scratch(spark) == kept
    assert pin_rows(docs).count() == 3


def test_batches_leave_their_results_alone(spark, texts, tmp_path):
    known = scratch(spark)
    run = encode_batches(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    run(texts("Mail jan@example.com", "Bel 0476/12.34.56"), 0)
    run(texts("Mail jan@example.com of piet@example.com"), 1)
    assert scratch(spark) == known
    out = {(r.batch, r.doc_id): r.sanitized for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "@" not in "".join(out.values()) and len(out) == 3
    whole = encode_corpus(texts("Mail jan@example.com", "Bel 0476/12.34.56"))
    assert {r.doc_id: r.sanitized for r in whole.documents.collect()} == {i: out[0, i] for i in (0, 1)}
