import re
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_contamination import plain as contaminated, words
from tests.llm.test_quality import plain_kept
from tests.llm.test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages_match_loops(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    out = {}
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns

    good = sorted(i for i, t in texts.items() if plain_kept(t))
    assert sorted(r.doc_id for r in out["quality"]) == good
    prints = {i: plain_fingerprint(texts[i]) for i in good}
    label = plain_components(prints.values())
    first = {}
    for i in good:
        first.setdefault(label[prints[i]], i)
    assert sorted(r.doc_id for r in out["near_duplicates"]) == sorted(first.values())
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = sorted(i for i in first.values() if not contaminated(texts[i], items)[1])
    assert sorted(r.doc_id for r in out["decontamination"]) == clean
    copies = Counter(r.doc_id for r in out["mixing"])
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    size = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))
    assert sum(n * size(i) for i, n in copies.items()) == pytest.approx(sum(map(size, clean)), rel=0.35)
    assert Counter(r.doc_id for r in out["sharding"]) == copies
    shards = Counter(r.shard for r in out["sharding"])
    assert max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r.slot for r in out["sharding"] if r.shard == s) == list(range(n)) for s, n in shards.items())


def test_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    odd = docs.selectExpr(
        "CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id", "text", "CASE WHEN doc_id % 4 > 0 THEN lang END AS lang",
        "CASE WHEN doc_id % 5 > 0 THEN source END AS source", "n_chars", "'x' AS shard", "doc_id AS `_rid`", "1 AS size",
    )
    for n, table in enumerate([odd.union(odd), odd.where("false")]):
        now = table
        for name, stage in P.STAGES:
            stage(spark, now, DATA).write.parquet(f"{tmp_path}/{n}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert (now.count() > 0) == (n == 0)
        assert "_rid" in now.columns and "slot" in now.columns


def test_very_long_texts(spark, tmp_path):
    """Texts of over 1 MB pass whole: copies go, a passage at the very end counts."""
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(words(r.text)) >= 10)
    body = [" ".join(f"{c}{i * 7919 % 400_009}" for i in range(200_000)) for c in ("ab", "cd")]
    texts = [body[0], body[0], body[1] + " " + item, "few words"]
    now = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    left = {}
    for name, stage in P.STAGES:
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = [r.doc_id for r in now.collect()]
    assert sorted(left["quality"]) == [0, 1, 2]
    assert sorted(left["near_duplicates"]) == [0, 2]
    assert left["decontamination"] == [0]
    assert set(left["mixing"]) == {0} and left["sharding"] == left["mixing"]
