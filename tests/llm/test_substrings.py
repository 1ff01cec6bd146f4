import re

from veilframe.llm import substrings as S
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def runs(units):
    """Stretches without None."""
    out = [[]]
    for u in units:
        if u is None:
            out.append([])
        else:
            out[-1].append(u)
    return [run for run in out if run]


def plain(docs, unit_words=S.UNIT_WORDS, run_words=S.RUN_WORDS):
    """(row, start, end, words, first id) of what goes; docs: (doc_id, text) in order."""
    ranked = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    first, cut = {}, {}
    for i in ranked:
        units = []
        for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", docs[i][1] or ""):
            words = re.findall(r"[^\x20\x09-\x0D]+", m[0])
            if words:
                key = " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words)
                late = key in first
                units.append((m.start(), m.end(), len(words), late, first.setdefault(key, docs[i][0])))
        cut[i] = units
    out = []
    for i, units in cut.items():
        for run in runs([u if u[3] else None for u in units]):
            long_run = sum(u[2] for u in run) >= run_words
            for part in runs([u if long_run or u[2] >= unit_words else None for u in run]):
                out.append((i, part[0][0], part[-1][1], sum(u[2] for u in part), part[0][4]))
    return sorted(out)


def test_query_matches_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    rows = QUERIES["op3_substrings"].run(spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.end, r.words, r.first_id) for r in rows) == plain(docs)


PASSAGE = "Öne two three four five. Six seven eight! Nine ten eleven twelve? " + "And thirteen more words " * 5 + "end."
DOCS = [
    (5, "Intro here. " + PASSAGE + " Own end."),
    (2, "mid line start " + PASSAGE.upper().replace("Ö", "Ö") + " tail\nAll rights reserved."),
    (9, "All rights reserved.\n\n" + PASSAGE.replace(" ", "  ")),
    (None, PASSAGE),
    (None, PASSAGE),
    (7, None),
    (8, ""),
    (8, " \n . \n"),
    (1, "Loop it again now please. " * 4000),
]


def test_odd_rows(spark):
    rows = [(d, t, "k", i) for i, (d, t) in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, place int").coalesce(1)
    want = plain(DOCS)
    out = S.drop_repeats(docs)
    assert out.columns == ["doc_id", "text", "place", "removed", "kept"]
    got = out.collect()
    assert len(got) == len(DOCS)
    for r in got:
        text = DOCS[r.place][1]
        assert [(s.start, s.end) for s in r.removed] == [(s, e) for i, s, e, *_ in want if i == r.place]
        assert (r.text or "") == "".join((text or "")[s.start : s.end] for s in r.kept)
        assert r.text is not None or text is None
    assert S.drop_repeats(docs.where("false")).count() == 0
    assert S.spans_table(docs.where("false")).count() == 0


def test_repeats_keep_no_short_copy(spark, tmp_path):
    docs = [
        (1, "A shared line of seven words here\nOwn text of one."),
        (2, "Own text of two.\na SHARED line of  seven words here\nEnd of two"),
        (3, "A short copy."),
        (4, "A short copy."),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op3_repeats"].run(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.start, r.end, r.words, r.first_id) for r in rows)
    assert got == [(2, 17, 52, 7, 1), (4, 0, 13, 3, 3)]


def test_repeats_match_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    rows = QUERIES["op3_repeats"].run(spark, DATA).collect()
    want = sorted((docs[i][0], *span) for i, *span in plain(docs, 1))
    assert sorted((r.doc_id, r.start, r.end, r.words, r.first_id) for r in rows) == want
