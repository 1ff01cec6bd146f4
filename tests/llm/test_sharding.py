import zlib

import numpy as np
import pytest

from veilframe.llm import sharding as S
from veilframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def matrix(counts, n_shards, seed):
    starts = np.cumsum([0, *counts])
    lines = [S.matrix_line(starts, p, n_shards, seed) for p in range(len(counts))]
    m = np.array([line for line, _ in lines])
    assert (np.array([before for _, before in lines]) == np.cumsum(m, axis=0) - m).all()
    return m


def test_matrix_has_exact_sums():
    for counts in ([0, 5, 100, 1, 37, 1000], [3], [0], [2 * 10**9, 10**9, 5 * 10**9]):
        m = matrix(counts, 7, 3)
        assert m.sum(axis=1).tolist() == counts
        assert m.sum(axis=0).tolist() == S.shard_sizes(sum(counts), 7).tolist()
        assert (m >= 0).all()


def test_cells_follow_the_law():
    """Each cell is hypergeometric, wherever its partition stands in the tree."""
    counts, n_shards, draws = [4, 0, 10, 6, 20], 4, 3000
    cells = np.array([matrix(counts, n_shards, seed) for seed in range(draws)])
    total, room = sum(counts), sum(counts) // n_shards
    for p, count in enumerate(counts):
        mean = count * room / total
        var = mean * (1 - room / total) * (total - count) / (total - 1)
        assert (abs(cells[:, p].mean(axis=0) - mean) < 5 * np.sqrt(var / draws) + 1e-9).all()
        assert (abs(cells[:, p].var(axis=0) - var) < 0.15 * var + 1e-9).all()


def test_many_shards_and_partitions():
    """A line of 20,000 partitions and 10,000 shards is drawn without the others."""
    counts = np.full(20_000, 50_000)
    line, before = S.matrix_line(np.cumsum([0, *counts]), 12_345, 10_000, 5)
    assert line.sum() == 50_000 and before.sum() == 12_345 * 50_000


def test_large_populations_follow_the_law():
    rng = np.random.default_rng(1)
    draws = [S.hypergeometric(rng, 3 * 10**9, 10**9, 400) for _ in range(3000)]
    assert abs(np.mean(draws) - 300) < 1
    assert abs(np.std(draws) - np.sqrt(400 * 0.75 * 0.25)) < 0.5


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 65_536])
def test_permutation(size):
    place = np.arange(size)
    one = S.permuted(place, np.full(size, size), np.full(size, 9))
    assert sorted(one.tolist()) == place.tolist()
    if size > 16:
        assert one.tolist() != S.permuted(place, np.full(size, size), np.full(size, 10)).tolist()


def test_shuffle_is_even():
    """Where a place ends up is spread over all slots."""
    size, keys = 8, 4000
    at = np.zeros((size, size))
    for k in range(keys):
        at[np.arange(size), S.permuted(np.arange(size), np.full(size, size), np.full(size, k))] += 1
    assert (abs(at / keys - 1 / size) < 0.025).all()


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"].run(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(25))
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert (r.law, r.grown_shard) == ("rows", None)
    again = QUERIES["op1_sharding"].run(spark, DATA).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_odd_rows(spark):
    rows = [(None, None, 5, "a"), (None, None, 5, "a"), (1, "", 6, "b"), (1, "x" * 200_000, 7, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int, _rid string").repartition(3)
    out = S.shard(docs, n_shards=3)
    assert out.columns == ["doc_id", "text", "_rid", "shard", "slot"]
    got = out.collect()
    assert sorted((r.doc_id or -1, r.text or "", r._rid or "") for r in got) == sorted(
        (a or -1, b or "", d or "") for a, b, _, d in rows
    )
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s, n in enumerate([7, 7, 6]) for i in range(n)]
    assert S.shard(docs.where("false")).count() == 0
    assert S.shard(docs.limit(2), n_shards=5).count() == 2
