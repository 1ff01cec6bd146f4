import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import negatives as N

SCHEMA = "vec_id long, label int, vector array<float>, chunk int, score string"


def plain(rows, is_anchor):
    """(anchor, positive, rank, negative, scores) by comparing all with all."""
    kept = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (anchor, label, v) in enumerate(kept):
        if not is_anchor(anchor):
            continue
        others = [(-score(v, w), k is None, k or 0, l, k) for j, (k, l, w) in enumerate(kept) if j != i]
        others.sort(key=lambda o: o[:3])
        for s, _, _, _, positive in [o for o in others if o[3] == label][:5]:
            good = [o for o in others if o[3] != label and -30 * s <= -100 * o[0] <= -90 * s][:10]
            out += [(anchor, positive, r, o[4], -s, -o[0]) for r, o in enumerate(good, 1)]
    return out


def by_rank(rows):
    return sorted(map(tuple, rows), key=repr)


def mined(spark, rows, every):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return by_rank(N.hard_negatives(frame, F.col("vec_id") % every == 0).collect())


def points(seed, n, dims, spread, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dims)
        rows.append((i, int(rng.integers(labels)), [float(x) for x in v.astype(np.float32)]))
    return rows


@pytest.mark.parametrize("spread,dims", [(0.2, 3), (1.0, 16)])
def test_matches_comparison_of_all(spark, monkeypatch, spread, dims):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "CHUNK", 4)
    rows = points(dims, 400, dims, spread)
    assert mined(spark, rows, 20) == by_rank(plain(rows, lambda i: i % 20 == 0))


def test_hot_vector_and_hot_label(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = points(3, 100, 4, 0.5) + [(1000 + i, 1, [0.5, 0.25, 0.5, 0.125]) for i in range(150)]
    rows += [(2000 + i, 2, [0.25, 0.125, 0.25, 0.125]) for i in range(60)]
    assert mined(spark, rows, 50) == by_rank(plain(rows, lambda i: i % 50 == 0))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (None, 1, [0.5, 0.5]), (None, 2, [0.5, 0.0]), (3, 2, [0.5]),
        (4, 2, []), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [nan, 1.0]), (8, 2, [inf, 0.0]), (9, 2, [None, 1.0]),
        (10, 1, [-1.0, -1.0]), (11, 2, [0.4, 0.1]), (11, 2, [0.4, 0.1]), (20, 3, [1e3, 2e3]),
    ]
    assert mined(spark, rows, 10) == by_rank(plain(rows, lambda i: i is not None and i % 10 == 0))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.hard_negatives(empty, F.col("vec_id") % 2 == 0).collect() == []
    lone = spark.createDataFrame([(1, 1, [1.0], 1, "x")], SCHEMA)
    assert N.hard_negatives(lone, F.col("vec_id") % 2 == 0).collect() == []
    assert N.hard_negatives(lone, F.col("vec_id") % 2 == 1).collect() == []


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    """The curve goes through every cell, one step at a time."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = N.curve_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys], dtype=np.int64), kind="stable")]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """On clustered points far fewer blocks are read than there are."""
    monkeypatch.setattr(N, "BLOCK", 16)
    reads = []
    scored = N.scored

    def counted(wanted, *rest):
        reads.append(wanted.count())
        return scored(wanted, *rest)

    monkeypatch.setattr(N, "scored", counted)
    rows = points(5, 2000, 3, 0.05, labels=2)
    got = mined(spark, rows, 400)
    assert got == by_rank(plain(rows, lambda i: i % 400 == 0))
    assert sum(reads) < 0.5 * 5 * 2000 / 16
