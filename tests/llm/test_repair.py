import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from veilframe.llm import repair as R
from veilframe.llm.queries import QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string, place string, segment int"
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """Cheapest edits of (role, fault) rows by trying all, least in ASCII order."""

    @lru_cache(None)
    def go(i, state, inserts):
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserts < 3:
            ways += [(c + 2, "I" + e) for c, e in [go(i, NEXT[state][0], inserts + 1)]]
        if i < len(rows):
            role, fault = rows[i]
            ways += [(c + 3, "D" + e) for c, e in [go(i + 1, state, 0)]]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in GOES:
                    ways += [(c + more, "K" + e) for c, e in [go(i + 1, GOES[state, role[:1]], 0)]]
                ways += [(c + 2 + more, "R" + e) for c, e in [go(i + 1, NEXT[state][0], 0)]]
        return min(ways, default=(10**9, ""))

    return go(0, 0, 0)


def plain_report(rows):
    """Report of (turn, role, text) rows by loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.search(r"[^\x20\x09-\x0D]", text)
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    cost, audit = plain_repair(tuple((r[1], f) for r, f in zip(rows, faults)))
    lines, state, left = [], 0, list(rows)
    for edit in audit:
        row = None if edit == "I" else left.pop(0)
        if edit in "IR":
            state, role = NEXT[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        elif edit == "K":
            state = GOES[state, row[1][:1]]
            lines.append(f"{row[1]}:{row[2]}")
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(n) for n in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(lines),
    )


def report_rows(df):
    return {r.conv_id: (*(r[c] for c in R.COUNTS), r.audit, r.lines) for r in R.reports(df).collect()}


def made(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for _ in range(n):
            turn = rng.choice([None, *range(max(n // 2, 1)), *range(n + 3)])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "Ünser", None])
            text = rng.choice(["One. ", "two", "Three?\n", "", " \t", None, f"n{rng.random()}!", "é😀."])
            rows.append((None if conv == 3 else conv, turn, role, text, "x", 1))
    return rows


def grouped(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_search_finds_cheapest_and_least():
    rng = random.Random(1)
    kinds = {"d": ("user", "blank"), "x": ("tool", ""), "s": ("system", ""), "u": ("user", ""), "a": ("assistant", "")}
    for _ in range(3000):
        letters = "".join(rng.choice("sssuuaadxXSUA") for _ in range(rng.randint(0, 12)))
        rows = [kinds[c] if c == "d" else (kinds[c.lower()][0], "truncated" if c.isupper() else "") for c in letters]
        assert R.search(letters)[:2] == plain_repair(tuple(rows)), letters


@pytest.mark.parametrize("segment", [256, 4, 1])
def test_reports_match_loops_whole_or_in_segments(spark, segment):
    rows = made(segment, [1, 2, 5, 9, 30, 12, 0, 61])
    rows += rows[:20]
    want = {conv: plain_report(r) for conv, r in grouped(rows).items()}
    got = report_rows(R.repair(spark.createDataFrame(rows, SCHEMA), segment))
    assert got == want


def test_long_conversation(spark):
    """Five thousand rows in segments cost what one search over all costs."""
    rows = made(9, [5000])
    (want,) = grouped(rows).values()
    (got,) = report_rows(R.repair(spark.createDataFrame(rows, SCHEMA))).values()
    faults = sum(got[1:4])
    assert 0 < faults < 5000
    ordered = sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters = set(), ""
    for _, role, text in ordered:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        cut = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:] not in ".!?"
        letter = role[:1] if role[:1] in set("sua") else "x"
        letters += "d" if blank or (role, text) in seen else letter.upper() if cut else letter
        seen.add((role, text))
    assert (got[5], got[6]) == R.search(letters)[:2]


def test_query_matches_loops_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    want = {}
    for r in rows:
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", r.text) if harm == 2 else r.text
        kept = want.setdefault(r.conv_id, [])
        kept += [(r.turn, "user" if harm == 4 else r.role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_repair"].run(spark, folder).collect()}
    assert len(got) == len(want)
    for conv, told in want.items():
        *counts, lines = plain_report(told)
        assert got[conv] == (*counts, hashlib.sha256(lines.encode()).hexdigest())


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, "x", 1), (0, 0, "user", None, "x", 1), (5, 1, "user", "a" * 300_000 + ".", "x", 1)]
    frame = spark.createDataFrame(rows * 2, SCHEMA)
    for n, table in enumerate([frame, frame.where("false")]):
        table.write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        told = QUERIES["op12_repair"].run(spark, f"{tmp_path}/{n}").collect()
        assert len(told) == (3 if n == 0 else 0)
    harm = {r.conv_id: r.n for r in damaged(frame).groupBy("conv_id").agg({"turn": "count"}).toDF("conv_id", "n").collect()}
    assert None in harm or zlib.crc32(b" : ") % 20 == 0
    assert R.reports(R.repair(frame.where("false"))).count() == 0
