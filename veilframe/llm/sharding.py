"""Uniform shuffle into shards of exact sizes by a communication matrix.

The rows are pinned in a table whose files are the input partitions.  How many rows
of each partition go to each shard is drawn from the multivariate hypergeometric
distribution, so shard sizes are exact (at most one apart) and counts are those of a
uniform shuffle.  The matrix is drawn by halves: the shard sizes are divided over the
first and the second half of the partitions, each part over its halves, and so on, each
time by a generator seeded with the range of partitions.  A task walks down to the line
of its own partition, so the matrix is nowhere whole, and its size sets no bound to
partitions or shards.  A row's place in its partition is permuted, which names its shard
by the partition's line of the matrix and its arrival there; the arrival is permuted
again into the slot.  Both permutations are computed for a row from its place alone,
so a task that runs again gives the same rows, and nothing is sorted or gathered.

* Rows that repeat, null ids and null texts are rows like others; ties do not arise,
  as places are distinct.  An empty table gives an empty result.
* Columns of the input named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ROW_BITS, stored

SHARDS = 8
SEED = 20_011

#: Populations up to this the random generator draws from by itself.
DIRECT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many good ones are among ``taken``; large populations by inversion,
    walking from the mode to both sides."""
    if not taken or not good:
        return 0
    if not bad:
        return taken
    if good + bad < DIRECT:
        return int(rng.hypergeometric(good, bad, taken))
    lg = math.lgamma
    least, most = max(0, taken - bad), min(good, taken)
    k = min(max((taken + 1) * (good + 1) // (good + bad + 2), least), most)
    log_p = (
        lg(good + 1) - lg(k + 1) - lg(good - k + 1)
        + lg(bad + 1) - lg(taken - k + 1) - lg(bad - taken + k + 1)
        - lg(good + bad + 1) + lg(taken + 1) + lg(good + bad - taken + 1)
    )
    low, high = k, k
    p_low = p_high = math.exp(log_p)
    rest = rng.random() - p_low
    while rest > 0 and (low > least or high < most):
        if high < most:
            p_high *= (good - high) * (taken - high) / ((high + 1) * (bad - taken + high + 1))
            high += 1
            rest -= p_high
            if rest <= 0:
                return high
        if low > least:
            p_low *= low * (bad - taken + low) / ((good - low + 1) * (taken - low + 1))
            low -= 1
            rest -= p_low
            if rest <= 0:
                return low
    return k


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    """Sizes at most one apart, the larger ones first."""
    return total // n_shards + (np.arange(n_shards, dtype=np.int64) < total % n_shards)


def divided(rng: np.random.Generator, line: np.ndarray, taken: int) -> np.ndarray:
    """How many of each shard are among ``taken`` of the line's rows."""
    left, part = int(line.sum()), np.zeros_like(line)
    if left < DIRECT:
        return rng.multivariate_hypergeometric(line, taken, method="marginals")
    for s, room in enumerate(line.tolist()):
        left -= room
        part[s] = hypergeometric(rng, room, left, taken)
        taken -= int(part[s])
    return part


def matrix_line(starts: np.ndarray, part: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sent from a partition to each shard, and from all partitions before it.

    ``starts`` are the running totals of the partitions' counts, from 0.  The lines sum
    up to the counts, and all of a shard to its size."""
    low, high = 0, len(starts) - 1
    line = shard_sizes(int(starts[-1]), n_shards)
    before = np.zeros(n_shards, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng((seed, low, high))
        first = divided(rng, line, int(starts[middle] - starts[low]))
        if part < middle:
            line, high = first, middle
        else:
            line, low, before = line - first, middle, before + first
    return line, before


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; unsigned numbers wrap around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A seeded permutation of 0..size-1, evaluated at ``place`` without the others:
    a Feistel network over the next power of four, walked until the result is inside."""
    out = place.astype(np.uint64)
    size = size.astype(np.uint64)
    width = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2 + 1e-9)
    half = width.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = _mixed(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    open_rows = np.arange(len(out))
    while len(open_rows):
        h, m, k = half[open_rows], mask[open_rows], key[open_rows]
        left, right = out[open_rows] >> h, out[open_rows] & m
        for i in range(rounds):
            step = np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64))
            turned = _mixed(right + k + step) & m
            left, right = right, left ^ turned
        out[open_rows] = (left << h) | right
        open_rows = open_rows[out[open_rows] >= size[open_rows]]
    return out.astype(np.int64)


def placed(
    starts: np.ndarray, part: int, rows: np.ndarray, line: np.ndarray, before: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of rows of one partition, given by their places in it."""
    count = starts[part + 1] - starts[part]
    sizes = shard_sizes(int(starts[-1]), len(line))
    ends = np.cumsum(line)
    local = permuted(rows, np.full(len(rows), count), np.full(len(rows), part + seed * 1_000_003))
    shards = np.searchsorted(ends, local, side="right")
    arrival = before[shards] + local - (ends - line)[shards]
    return shards, permuted(arrival, sizes[shards], shards + np.int64(seed) * 1_000_003 + 500_009)


def shard(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (gapless from 0 in a shard), exchanged so
    that a partition holds a stretch of slots."""
    spark = docs.sparkSession
    kept = stored(docs, "shard-input")
    part = F.shiftright("_rid", ROW_BITS)
    # One row a partition of the input.
    found = {r["part"]: r["count"] for r in kept.rows.groupBy(part.alias("part")).count().collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=0) + 1)]
    total = sum(counts)
    shared = spark.sparkContext.broadcast(np.cumsum([0, *counts], dtype=np.int64))

    @F.pandas_udf("shard int, slot long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for parts, rows in batches:
            p, places = parts.to_numpy(), rows.to_numpy()
            shards, slots = np.zeros(len(p), dtype=np.int32), np.zeros(len(p), dtype=np.int64)
            for one in np.unique(p).tolist():
                if one not in drawn:  # a task reads a file from its start to its end
                    drawn = {one: matrix_line(shared.value, one, n_shards, seed)}
                at = np.flatnonzero(p == one)
                shards[at], slots[at] = placed(shared.value, one, places[at], *drawn[one], seed)
            yield pd.DataFrame({"shard": shards, "slot": slots})

    row = F.col("_rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    located = kept.rows.withColumn("_at", place(part, row))
    shown = kept.original(
        located.withColumn("shard", F.col("_at.shard")).withColumn("slot", F.col("_at.slot")).drop("_at", "_rid"),
        without=("shard", "slot"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each, longer = divmod(total, n_shards)
    start = F.col("shard").cast("long") * each + F.least(F.col("shard"), F.lit(longer))
    rank = start.cast("double") + F.col("slot")
    task = F.floor(rank * tasks / max(1, total)).cast("int")
    return shown.repartitionById(tasks, task).sortWithinPartitions("shard", "slot")
