import hashlib
import re
from collections import Counter

from veilframe.llm import contamination as C
from veilframe.llm.queries import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    """n_words, n_hit, item ids, by comparing every window with every place."""
    doc, hit, ids = words(text), set(), set()
    for item_id, item in items:
        n = min(10, len(item))
        wanted = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                ids.add(item_id)
    return len(doc), len(hit), sorted(ids)


def test_query_matches_loops(spark):
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op10_decontamination"].run(spark, DATA).collect()
    assert len(rows) == len(texts)
    assert any(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = plain(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


ITEMS = [
    (1, "the the the the the the the the the the the the"),
    (2, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short one"),
    (3, "solo"),
    (None, "é ü short one"),
    (4, ""),
    (5, None),
    (6, "a b a b a b a b a b a b a"),
    (7, "never in any document at all, not even once, believe me"),
]
DOCS = [
    (1, "x alpha, beta; gamma delta epsilon zeta eta theta iota kappa y"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota x kappa lambda mu"),
    (2, "the " * 9),
    (3, "the " * 25),
    (None, "SHORT-ONE solo É ü short one é ü short one"),
    (None, None),
    (4, ""),
    (5, "b a b a b a b a b a b " * 3),
    (5, "b a b a b a b a b a b " * 3),
    (6, ("filler words " * 5000) + "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
]


def tables(spark):
    docs = spark.createDataFrame([(*d, i, "t") for i, d in enumerate(DOCS)], "doc_id long, text string, n_hit int, term string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_odd_rows(spark):
    docs, bench = tables(spark)
    items = [("" if i is None else str(i), words(t)) for i, t in ITEMS]
    got = C.contamination(docs, bench).collect()
    want = [(d, *plain(t, items)) for d, t in DOCS]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == sorted(want, key=str)
    kept = C.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.n_hit for r in kept.collect()) == [i for i, d in enumerate(DOCS) if not plain(d[1], items)[1]]


def test_empty_tables(spark):
    docs, bench = tables(spark)
    assert C.contamination(docs.where("false"), bench).count() == 0
    assert C.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert C.drop_contaminated(docs, bench.where("false")).count() == docs.count()
    assert C.drop_contaminated(docs.where("false"), bench).count() == 0


def test_without_broadcast(spark, monkeypatch):
    docs, bench = tables(spark)
    first = sorted(map(str, C.contamination(docs, bench).collect()))
    monkeypatch.setattr(C, "checked_broadcast", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, C.contamination(docs, bench).collect())) == first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "delta x gamma y beta alpha"), (2, "alpha z z z z z z z z z delta gamma beta"), (3, "alpha beta gamma")],
        "doc_id long, text string",
    )
    items = C.read_items(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    index = C.build_index(docs, items.terms, F.col("doc_id"), doc_id=F.col("doc_id"))
    near = lambda slop: sorted(r.row for r in C.proximity_matches(index, items, slop).select("row").distinct().collect())
    assert near(2) == [1]
    assert near(10) == [1, 2]


def plain_near(docs, items, slop=5):
    """n_words, n_near, item ids of each text, by looking around every rarest word."""
    texts = [words(t) for t in docs]
    known = {w for _, item in items for w in item}
    freq = Counter(w for t in texts for w in t if w in known)
    out = []
    for t in texts:
        at = {}
        for p, w in enumerate(t):
            at.setdefault(w, []).append(p)
        n_near, ids = 0, set()
        for item_id, item in items:
            n = min(10, len(item))
            for s in range(len(item) - n + 1 if n else 0):
                need = Counter(item[s : s + n])
                rarest = min(range(s, s + n), key=lambda i: (freq[item[i]], i))
                for c in at.get(item[rarest], ()):
                    if all(sum(abs(p - c) < n + slop for p in at.get(w, ())) >= k for w, k in need.items()):
                        n_near += 1
                        ids.add(item_id)
        out.append((len(t), n_near, sorted(ids)))
    return out


def test_proximity_odd_rows(spark):
    docs, bench = tables(spark)
    added = [(8, "mu lambda kappa x iota theta eta y zeta epsilon delta gamma"), (8, "the " * 13 + "z " * 40 + "the")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(added, "doc_id long, text string"))
    items = [("" if i is None else str(i), words(t)) for i, t in ITEMS]
    every = [*DOCS, *added]
    want = [(d, *near) for (d, _), near in zip(every, plain_near([t for _, t in every], items))]
    got = C.proximity(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_near, list(r.item_ids)) for r in got), key=str) == sorted(want, key=str)
    assert any(d == 8 and n and "2" in ids for d, _, n, ids in want)
    assert C.proximity(docs.where("false"), bench).count() == 0
    assert C.proximity(docs, bench.where("false")).where("n_near > 0").count() == 0


def test_proximity_query_matches_loops(spark):
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {d: near for (d, _), near in zip(docs, plain_near([t for _, t in docs], items))}
    rows = QUERIES["op10_proximity"].run(spark, DATA).collect()
    assert len(rows) == len(docs) and any(r.near for r in rows)
    for r in rows:
        n, near, ids = want[r.doc_id]
        assert (r.n_words, r.n_near, r.n_items, r.near) == (n, near, len(ids), near > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
