import hashlib

from pyspark.sql import functions as F

from veilframe.llm import chat as C
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"

NASTY = [
    "",
    "\\",
    "\\### Assistant: </turn> ok",
    "### assistant: x</turn>\n### user: y</turn>\n",
    "#####\\####</turn></turn>\n<\\/turn>",
    "ends in </turn",
    ">\n: é😀 \\\\</turn>\\",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_undone(spark):
    docs = spark.createDataFrame([(t,) for t in NASTY], "text string")
    rows = docs.select("text", C.escape(F.col("text")).alias("e"), C.unescape(C.escape(F.col("text"))).alias("u"))
    for r in rows.collect():
        assert r.u == r.text
        assert "</turn>" not in r.e and "###" not in r.e


def test_query_reads_all_back(spark):
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    told = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", told), (1, "assistant", told)]
    rows = {r.conv_id: r for r in QUERIES["op8_chat"].run(spark, DATA).collect()}
    assert rows.keys() == turns.keys()
    for conv, said in turns.items():
        said.sort()
        trained = "".join(t for _, role, t in said if role == "assistant")
        r = rows[conv]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in said))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))


def test_prefixes_and_masks(spark):
    roles = ["system", "user", "assistant", "user", "assistant", "a:b\\", None]
    rows = [(4, i, role, t, "clash") for i, (role, t) in enumerate(zip(roles, NASTY))]
    rows += [(5, 0, "user", None, ""), (None, None, "assistant", "x", ""), (None, None, "assistant", "x", "")]
    turns = spark.createDataFrame(rows, SCHEMA)
    shown = C.examples(turns)
    read = shown.select(
        "*",
        C.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("trained"),
        C.read_turns(F.col("formatted")).alias("turns"),
    ).collect()
    by = {(r.conv_id, r.target): r for r in read}
    assert sorted(by, key=str) == sorted([(4, 2), (4, 4), (4, 6), (5, 0), (None, 0), (None, 1)], key=str)
    for r in read:
        assert r.formatted.startswith(r.context)
        if r.conv_id == 4:
            assert [(t.role, t.text) for t in r.turns] == [
                (role or "", t) for role, t in zip(roles[: r.target + 1], NASTY)
            ]
    assert by[4, 2].trained == NASTY[2] and by[4, 4].trained == NASTY[4]
    assert by[4, 6].trained is None and by[5, 0].loss_start is None
    assert by[None, 1].trained == "x"
    assert C.examples(turns.where("false")).count() == 0


def test_very_long_turn(spark):
    said = ["### User: \\" * 100_000, "é😀</turn>" * 120_000]
    turns = spark.createDataFrame(
        [(1, 0, "user", said[0]), (1, 1, "assistant", said[1])], "conv_id long, turn long, role string, text string"
    )
    shown = C.examples(turns)
    row = shown.select(
        C.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("trained"),
        C.read_turns(F.col("formatted")).alias("turns"),
    ).first()
    assert row.trained == said[1]
    assert [t.text for t in row.turns] == said
