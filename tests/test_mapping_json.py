"""Mapping files read in splits of any size."""

import json
import random

import pytest

from veilframe.sources import mapping_json as M

NASTY = ['"', "\\", '\\"', '": {', '"PERSON_009": {"canonical": "x"}', "é😀", "a\nb", ", ", "{", "}", "]", ":", "", ' ": { "', "\u2028"]


def made(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))
    mappings = {}
    for i in range(n):
        entry = {"canonical": word(), "variations": [word() for _ in range(rng.randint(0, 3))], "occurrences": i}
        if i % 7 == 0:
            del entry["variations"]
        if i % 5 == 0:
            del entry["occurrences"]
        mappings[f"PERSON_{i + 1:03d}"] = dict(sorted(entry.items(), key=lambda _: rng.random()))
    return {"version": "1.0", "created": "x", "statistics": {"PERSON": n}, "mappings": mappings}


def expected(mapping):
    return sorted(
        (k, v["canonical"], v.get("variations", [v["canonical"]]), v.get("occurrences", 1))
        for k, v in mapping["mappings"].items()
    )


STYLES = [{"indent": 2}, {"indent": 2, "ensure_ascii": False}, {"indent": "\t"}, {}, {"separators": (",", ":")}]


@pytest.mark.parametrize("style", range(len(STYLES)))
@pytest.mark.parametrize("split", [1, 3, 17, 64, 1000, 10**6])
def test_every_split_size_finds_all(tmp_path, monkeypatch, style, split):
    monkeypatch.setattr(M, "STEP", 16)
    monkeypatch.setattr(M, "ENTRY", 8)
    mapping = made(12 if split < 3 else 40, style)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(mapping, **STYLES[style]), encoding="utf-8")
    reader = M.MappingReader(str(path), split)
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    got = sorted((r["placeholder"], r["canonical"], r["variations"], r["occurrences"]) for r in rows)
    assert got == expected(mapping)
    places = [r["entry_no"] for r in sorted(rows, key=lambda r: r["placeholder"])]
    assert places == sorted(places)


def test_large_mapping_in_many_tasks(spark, tmp_path):
    mapping = made(20_000)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(mapping, indent=2), encoding="utf-8")
    rows = M.read_large_mapping(spark, str(path), 1 << 16)
    got = sorted((r.placeholder, r.canonical, r.variations, r.occurrences) for r in rows.collect())
    assert got == expected(mapping)


def test_parts_and_single_files(spark, tmp_path):
    mapping = made(50)
    text = json.dumps(mapping, indent=2)
    cut = text.index('    "PERSON_020"')
    (tmp_path / "part-0").write_text(text[:cut])
    (tmp_path / "part-1").write_text(text[cut:])
    (tmp_path / "_SUCCESS").write_text("")
    rows = M.read_large_mapping(spark, str(tmp_path), 100).collect()
    assert sorted(r.placeholder for r in rows) == sorted(mapping["mappings"])
    each = M.read_large_mapping(spark, str(tmp_path), per_file=True).groupBy("scope_id").count().collect()
    assert sorted(r["count"] for r in each) == [19, 31]


def test_last_of_equal_names_counts(spark, tmp_path):
    entry = '"X_001": {"canonical": "%s"}'
    (tmp_path / "m.json").write_text('{"mappings": {%s, %s}}' % (entry % "a", entry % "b"))
    (row,) = M.read_large_mapping(spark, str(tmp_path / "m.json")).collect()
    assert (row.canonical, row.variations, row.occurrences, row.category, row.num) == ("b", ["b"], 1, "X", 1)


def test_no_entries(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"mappings": {}}')
    (tmp_path / "empty").mkdir()
    assert M.read_large_mapping(spark, str(tmp_path / "m.json")).count() == 0
    assert M.read_large_mapping(spark, str(tmp_path / "empty")).count() == 0
