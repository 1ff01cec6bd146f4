import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import simhash as H
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Class of each fingerprint, by comparing all with all."""
    todo, label = set(prints), {}
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            near = {b for b in todo if any((a ^ b).bit_count() <= 2 for a in front)}
            todo -= near
            front = near
        for g in group:
            label[g] = min(group)
    return label


def unsigned(x):
    return x & (2**64 - 1)


def test_query_matches_comparison_of_all(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    prints = {i: plain_fingerprint(t) for i, t in docs}
    label = plain_components(prints.values())
    first = {}
    for i, p in prints.items():
        first[label[p]] = min(i, first.get(label[p], i))
    rows = QUERIES["op9_near_duplicates"].run(spark, DATA).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted(
        (i, f"{p:016x}", first[label[p]]) for i, p in prints.items()
    )


def clustered(seed, centres, each):
    """Fingerprints in dense clouds and long chains, all sharing segments."""
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.int64):
        c = int(c)
        for _ in range(each):
            flips = rng.choice(64, size=rng.integers(0, 4), replace=False)
            out.add(c ^ sum(1 << int(b) for b in flips))
        for b in range(0, 60, 2):
            c ^= 3 << b
            out.add(c)
    return out


def test_crowded_segments_lose_no_link(spark):
    values = clustered(5, 3, 400)
    label = plain_components(values)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    rows = H.classes(spark.createDataFrame(signed, "bits long")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.root, set()).add(unsigned(r.bits))
    want = {}
    for v in values:
        want.setdefault(label[v], set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chain_budgets():
    assert H.BUDGETS == (0, 1, 2)


ROWS = [
    (3, "one two three four five", "x"),
    (1, "One two THREE four five", "y"),
    (1, "one two three four five", "y"),
    (None, "one two three four five", "z"),
    (None, None, "n"),
    (7, "", "e"),
    (8, " \n\t", "e"),
    (9, "hi", "s"),
    (9, "hi", "s"),
    (10, "été Été ÉTÉ", "u"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string, bits string")
    rows = H.near_duplicates(docs).select("doc_id", "component_id", H.hex_digits(F.col("bits")).alias("f"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in rows.collect())
    assert got == sorted(
        [("3", "1"), ("1", "1"), ("1", "1"), ("None", "1"), ("None", "7"), ("7", "7"), ("8", "7"),
         ("9", "9"), ("9", "9"), ("10", "10")]
    )
    kept = H.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.bits) for r in kept.collect()) == [(1, "y"), (7, "e"), (9, "s"), (10, "u")]
    lone = H.keep_one(docs.where("doc_id IS NULL AND text IS NULL")).collect()
    assert [tuple(r) for r in lone] == [(None, None, "n")]
    assert H.near_duplicates(docs.where("false")).count() == 0
    assert H.keep_one(docs.where("false")).count() == 0


def test_very_long_texts(spark):
    """Whole texts count: two that differ behind 2 MB of equal words differ in their bits."""
    import random

    rng = random.Random(4)
    start = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    tails = [" ".join(f"{c}{rng.randrange(50_000)}" for _ in range(300_000)) for c in "xy"]
    texts = [start, start, start + " " + tails[0], start + " " + tails[1], start.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in H.near_duplicates(docs).select("*", H.hex_digits(F.col("bits")).alias("f")).collect()}
    want = [plain_fingerprint(t) for t in texts]
    assert [got[i].f for i in range(5)] == [f"{v & (2**64 - 1):016x}" if isinstance(v, int) else v for v in want]
    assert got[0].component_id == got[1].component_id == got[4].component_id == 0
    assert got[2].f != got[3].f
