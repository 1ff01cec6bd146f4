import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import quality as Q
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BLANK = r"[\x20\x09-\x0D]"


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), failed


def plain_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars, symbols, dup, _, failed = plain_base(text)
    if failed:
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    capitals = sum("A" <= c <= "Z" for c in text)
    lettered = sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) for w in words)
    return not (
        10 * doubled > 3 * n or 2 * dup > len(lines) or 10 * symbols > n or chars < 2 * n
        or chars > 12 * n or 2 * capitals > chars or 2 * lettered < n
    )


TEXTS = [
    None,
    "",
    "  \n\t ",
    "one two three four five six seven eight nine ten",
    "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z é ü x",
    "line one is here\nline one is here\nline one is here\n" + " ".join(f"word{i}" for i in range(80)),
    "x" * 300_000,
    " ".join(["the cat sat on the mat"] * 50_000),
    "A | B | C | D | E | F | G | H | I | J | K | L",
    "SHOUTING ALL OF THIS TEXT IN CAPITALS WITHOUT ANY REST FOR THE READER",
    "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17",
]


def check(rows, texts):
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t)
        assert r.kept == plain_kept(t), r.doc_id


def test_query_matches_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = QUERIES["op4_quality"].run(spark, DATA).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.text for r in docs.collect()})


def test_odd_texts_in_any_order(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, kept int")
    order = list(Q.RULES)
    for some in (order, order[::-1]):
        rows = docs.select("doc_id", Q.report(F.col("text"), some).alias("r")).select("doc_id", "r.*").collect()
        check(rows, TEXTS)
        why = docs.select("doc_id", Q.rejection(F.col("text"), some).alias("why")).collect()
        assert {r.doc_id for r in why if r.why is None} == {i for i, t in enumerate(TEXTS) if plain_kept(t)}
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if plain_kept(t)}
    assert Q.keep_good(docs.where("false")).count() == 0


def test_order_goes_by_rejections_per_second():
    names, features = list(Q.RULES), list(Q.PARTS)
    seconds = np.full((10, len(features)), 0.1)
    seconds[:, features.index("n_capitals")] = seconds[:, features.index("word_chars")] = 0.01
    seconds[:, features.index("n_doubled")] = 0.2
    rejects = np.zeros((10, len(names)), dtype=bool)
    rejects[:5, names.index("symbols")] = True
    rejects[:2, names.index("capitals")] = True
    rejects[:5, names.index("doubled_words")] = True  # no more than symbols rejects before it
    rejects[5:8, names.index("repeated_lines")] = True
    order = Q.greedy_order(rejects, seconds)
    # 2 for 0.02 s a text; of the eight left 3 for 0.2 s, before 3 for 0.3 s; then words are there
    assert [(o[0], o[1], o[2]) for o in order[:3]] == [("capitals", 10, 2), ("repeated_lines", 8, 3), ("symbols", 5, 3)]
    assert {o[0]: o[2] for o in order}["doubled_words"] == 0
    assert {o[0] for o in order[3:5]} == {"few_words", "word_length"}  # all they look at is there
    profiled = [{"rule": o[0], "place": i} for i, o in enumerate(order)]
    assert Q.cascade_order(profiled[::-1]) == [o[0] for o in order]
    assert Q.cascade_order([]) == names
    empty = Q.greedy_order(rejects[:0], seconds[:0])
    assert sorted(o[0] for o in empty) == sorted(names)


def test_parts_come_first_and_are_all():
    """A rule computes what ``LOOKS_AT`` and ``PARTS`` say, and nothing else."""
    for name, rule in Q.RULES.items():
        t = Q.Text(b"one two three four five six seven eight nine ten eleven\ntwelve")
        rule(t)
        assert set(t.__dict__) - {"raw"} == Q.needed(name), name
    assert all(list(Q.PARTS).index(p) < i for i, f in enumerate(Q.PARTS) for p in Q.PARTS[f])


def test_profile_sees_rows_of_all_parts(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 40 + 1)) for i in range(400)], "doc_id int, text string")
    seen = Q.profile(docs.repartition(7), rows=50)
    assert sorted(r["rule"] for r in seen) == sorted(Q.RULES)
    assert max(r["n"] for r in seen) == 50
    assert Q.profile(docs.where("false")) == [] or max(r["n"] for r in Q.profile(docs.where("false"))) == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    verdict = QUERIES["op4_quality"].run(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    assert docs.count() >= verdict.count() > 300
    good = verdict.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() == 0
    bad = verdict.where("quality = 0")
    assert bad.where("kept").count() <= 0.02 * bad.count()
