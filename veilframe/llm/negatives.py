r"""Hard negatives by Hilbert-ordered blocks with zone maps.

Vectors are quantised to whole numbers, so every score (inner product) is exact.  Rows
are sorted by label and their place on a Hilbert curve over all dimensions and stored in
Parquet as blocks of up to ``BLOCK`` rows of one label; a block's zone map holds the least
and largest value of each dimension.  Anchors go in chunks of up to ``CHUNK``.

A search answers windows: the best ``need`` rows of an anchor whose score lies from ``lo``
to ``hi``.  Interval arithmetic over an anchor and a zone map bounds the scores of a
block from both sides.  First each anchor reads the one block with the highest bound; the
score of its last place found is the new ``lo`` of the window; then every block is read
whose bounds still meet a window, and no other.  The same search runs twice: for the
positives (blocks of the anchor's label, no limits) and for the negatives (blocks of other
labels, one window a positive).  No row is dropped or sampled; blocks that are not read
cannot hold a result.

Chunks meet the zone maps of one range of blocks at a time, and a block meets a chunk only
if one of its anchors has to read it.  A chunk's and a block's size are fixed, so no task
holds more than a few of them however frequent a label or a vector is.

* A row with a null label or vector, or with a null or non-finite component, takes no part.
* A shorter vector counts as filled up with zeros, an empty one is all zeros.  Components
  are held to what keeps a hundred times any score within a long (at 64 dimensions and
  scale 256, inputs within 92,000 are not touched).
* Ties go by vec_id (null last), then by place in the blocks.  Rows that repeat are rows of
  their own: an anchor that repeats is answered as often, and its copies are other rows.
* An empty table, or one without anchors, gives an empty result.  Columns other than those
  named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import written

BLOCK, CHUNK = 1024, 512
PLACE_BITS, SEQUENCE_BITS = 10, 26  # of a row in its block, of a block in its range
CURVE_BITS = 4  # a dimension
SCALE = 256
ANY = 1 << 62

RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


# --- places on the curve --------------------------------------------------------------


def curve_keys(coordinates: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Sortable places on the Hilbert curve of points (rows) with whole coordinates below
    2^bits: the coordinates' bits are turned into those of the place, plane by plane."""
    axes = coordinates.T.astype(np.uint32)  # one row a dimension
    if not len(axes):
        return [b""] * coordinates.shape[0]
    plane = 1 << (bits - 1)
    while plane > 1:
        below = np.uint32(plane - 1)
        for axis in axes:
            high = (axis & plane) != 0
            swapped = np.where(high, 0, (axes[0] ^ axis) & below).astype(np.uint32)
            axes[0] ^= np.where(high, below, 0).astype(np.uint32)
            axes[0] ^= swapped
            axis ^= swapped
        plane >>= 1
    for before, axis in zip(axes, axes[1:]):
        axis ^= before
    turn = np.zeros_like(axes[0])
    for p in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> p & 1, (1 << p) - 1, 0).astype(np.uint32)
    axes ^= turn
    planes = [(axes >> b & 1).T for b in range(bits - 1, -1, -1)]
    return [k.tobytes() for k in np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)]


# --- blocks -----------------------------------------------------------------------------


def quantised(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component as an array of longs; null where one is null or
    not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.least(x * scale, F.lit(float(limit))), F.lit(float(-limit)))
    return F.when(~odd, F.transform(wide, lambda x: F.floor(held(x)).cast("long")))


def extent(rows: DataFrame, vector: str, scale: int) -> tuple[int, int]:
    """Most components of a vector, and the largest that one is in size once quantised."""
    finite = F.filter(F.transform(vector, lambda x: F.abs(x.cast("double"))), lambda x: x < float("inf"))
    top = rows.agg(F.max(F.size(vector)).alias("dims"), F.max(F.array_max(finite)).alias("most")).first()
    dims = max(top.dims or 0, 1)
    return dims, int(max(min((top.most or 0.0) * scale + 1, math.isqrt((1 << 55) // dims)), 1))


def with_keys(rows: DataFrame, dims: int, largest: int) -> DataFrame:
    """vec_id, label, is_anchor, packed vector and place on the curve."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            points = np.zeros((batch.num_rows, dims), np.int64)
            points[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            cells = (points + largest) * (1 << CURVE_BITS) // (2 * largest + 1)
            packed = [p.tobytes() for p in points.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary()),
                 pa.array(curve_keys(cells), pa.binary())],
                names=["vec_id", "label", "is_anchor", "point", "key"],
            )

    slim = rows.select("vec_id", "label", "is_anchor", "v")
    return slim.mapInArrow(keyed, "vec_id long, label long, is_anchor boolean, point binary, key binary")


BLOCKS = (
    "range int, block long, label long, ids array<long>, anchors array<int>, points binary, "
    "low binary, high binary"
)


def blocks_of(keyed: DataFrame, dims: int) -> DataFrame:
    """Stored blocks of rows in order of label and place on the curve."""
    order = ["label", "key", "vec_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.binary()] * 3

    def packed(rows: list[tuple], number: int) -> pa.RecordBatch:
        ids, labels, flags, points, ranges = zip(*rows)
        values = np.frombuffer(b"".join(points), np.int32).reshape(-1, dims)
        row = [
            ranges[0], ranges[0] << SEQUENCE_BITS | number, labels[0], ids, [i for i, f in enumerate(flags) if f],
            values.tobytes(), values.min(axis=0).tobytes(), values.max(axis=0).tobytes(),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(row, kinds)],
            names=[f.split()[0] for f in BLOCKS.split(", ")],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == BLOCK or held[0][1] != row[1]):
                    yield packed(held, number)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield packed(held, number)

    numbered = ranged.select("vec_id", "label", "is_anchor", "point", F.spark_partition_id().alias("range"))
    return written(numbered.mapInArrow(pack, BLOCKS), "blocks")


def anchor_chunks(blocks: DataFrame, dims: int) -> DataFrame:
    """Stored chunks of anchors of one label: chunk, label, uids, ids, points."""
    width = 4 * dims
    own = F.transform(
        "anchors",
        lambda i: F.struct(
            (F.shiftleft("block", PLACE_BITS) + i).alias("uid"),
            F.get("ids", i).alias("vec_id"),
            F.substring(F.col("points"), i * width + 1, F.lit(width)).alias("point"),
        ),
    )
    anchors = blocks.where(F.size("anchors") > 0).select("label", F.inline(own))
    ranged = anchors.repartitionByRange("label", "uid").withColumn("range", F.spark_partition_id())
    line = Window.partitionBy("range", "label").orderBy("uid")
    cut = written(ranged, "anchors").withColumn("part", F.floor((F.row_number().over(line) - 1) / CHUNK))
    chunks = cut.groupBy("range", "label", "part").agg(
        F.min("uid").alias("chunk"),
        F.sort_array(F.collect_list(F.struct("uid", "vec_id", "point"))).alias("a"),
    )
    # Not a fold: each step of one would copy all bytes so far.
    points = F.unhex(F.array_join(F.transform("a", lambda x: F.hex(x.point)), ""))
    return written(
        chunks.select(
            "chunk", "label", F.col("a.uid").alias("uids"), F.col("a.vec_id").alias("ids"), points.alias("points")
        ),
        "chunks",
    )


# --- search -----------------------------------------------------------------------------


def number_type(dims: int, largest: int) -> type:
    """Doubles multiply fast and are exact up to 2^53."""
    return np.float64 if dims * largest * largest < 1 << 53 else np.int64


def matrix(data: bytes, dims: int, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, dims).astype(kind)


def bounded(
    asked: DataFrame, zones: DataFrame, same_label: bool, dims: int, kind: type, probe: bool
) -> DataFrame:
    """chunk, block, owner, bound: the blocks that a chunk's anchors have to read; with
    ``probe`` the best block of each range for each anchor."""

    def meet(row: dict) -> tuple[np.ndarray, ...] | None:
        fits = [z for z in row["zones"] if (z["label"] == row["label"]) == same_label]
        if not fits or not row["windows"]:
            return None
        a = matrix(row["points"], dims, kind)
        low = matrix(b"".join(z["low"] for z in fits), dims, kind)
        high = matrix(b"".join(z["high"] for z in fits), dims, kind)
        block = np.array([z["block"] for z in fits], np.int64)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        most = (up @ high.T + down @ low.T).astype(np.int64)
        least = (up @ low.T + down @ high.T).astype(np.int64)
        owner, lo, hi = (np.array([w[k] for w in row["windows"]], np.int64) for k in ("owner", "lo", "hi"))
        meets = (most[owner] >= lo[:, None]) & (least[owner] <= hi[:, None])
        begins = np.flatnonzero(np.diff(owner, prepend=-1))  # windows go by owner
        wanted = np.zeros(most.shape, bool)
        wanted[owner[begins]] = np.logical_or.reduceat(meets, begins, axis=0)
        wanted &= block[None, :] != np.array(row["probes"], np.int64)[:, None]
        if probe:
            best = np.where(wanted, most, -ANY).argmax(axis=1)
            wanted &= np.arange(len(block))[None, :] == best[:, None]
        owners, places = np.nonzero(wanted)
        return owners, block[places], most[owners, places]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = meet(row)
                if found is not None:
                    owners, blocks, bounds = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(owners), row["chunk"], np.int64)), pa.array(blocks),
                         pa.array(owners.astype(np.int32)), pa.array(bounds)],
                        names=["chunk", "block", "owner", "bound"],
                    )

    last = zones.agg(F.max("range")).first()[0]  # ranges are numbered from 0
    met = asked.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(zones, "range")
    return met.select("chunk", "label", "points", "windows", "probes", "zones").mapInArrow(
        judge, "chunk long, block long, owner int, bound long"
    )


FOUND = "chunk long, window int, score long, no_id boolean, vec_id long, uid long"


def scored(
    reads: DataFrame, asked: DataFrame, blocks: DataFrame, need: int, dims: int, kind: type
) -> DataFrame:
    """The best ``need`` rows of each window in each block that is read (chunk, block,
    owners)."""

    def of_block(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
        owners = sorted(row["owners"])
        place_of = {owner: i for i, owner in enumerate(owners)}
        b = matrix(row["block_points"], dims, kind)
        scores = (matrix(row["points"], dims, kind)[owners] @ b.T).astype(np.int64)
        uids = (row["block"] << PLACE_BITS) + np.arange(len(b))
        no_id = np.array([i is None for i in row["block_ids"]])
        ids = np.array([i or 0 for i in row["block_ids"]], np.int64)
        for w, window in enumerate(row["windows"]):
            if window["owner"] not in place_of:
                continue
            own = scores[place_of[window["owner"]]]
            other = uids != row["uids"][window["owner"]]
            fits = np.flatnonzero((own >= window["lo"]) & (own <= window["hi"]) & other)
            if len(fits) > need:  # those at least as good as the last place
                fits = fits[own[fits] >= np.partition(own[fits], -need)[-need]]
            fits = fits[np.lexsort((uids[fits], ids[fits], no_id[fits], -own[fits]))][:need]
            yield np.full(len(fits), w, np.int32), own[fits], no_id[fits], ids[fits], uids[fits]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = list(of_block(row))
                if found:
                    window, value, none, ids, uids = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(window), row["chunk"], np.int64)), pa.array(window), pa.array(value),
                         pa.array(none), pa.array(ids, mask=none), pa.array(uids)],
                        names=[f.split()[0] for f in FOUND.split(", ")],
                    )

    read = blocks.select("block", F.col("ids").alias("block_ids"), F.col("points").alias("block_points"))
    chunks = asked.select("chunk", "uids", "points", "windows")
    return reads.join(read, "block").join(chunks, "chunk").mapInArrow(score, FOUND)


def best(found: DataFrame, need: int) -> DataFrame:
    order = [F.desc("score"), F.asc("no_id"), F.asc("vec_id"), F.asc("uid")]
    line = Window.partitionBy("chunk", "window").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= need)


def search(
    asked: DataFrame, blocks: DataFrame, need: int, same_label: bool, dims: int, kind: type
) -> DataFrame:
    """chunk, window, rank, score, vec_id: the best rows of each window of ``asked``
    (chunk, label, uids, points, windows by owner)."""
    zone = F.struct("block", "label", "low", "high")
    zones = written(blocks.groupBy("range").agg(F.collect_list(zone).alias("zones")), "zones")
    nothing = F.lit(-1).cast("long")
    asked = written(asked.withColumn("probes", F.transform("uids", lambda _: nothing)), "asked")

    def read(wanted: DataFrame) -> DataFrame:
        return wanted.groupBy("chunk", "block").agg(F.collect_list("owner").alias("owners"))

    tops = bounded(asked, zones, same_label, dims, kind, probe=True)
    top = F.max_by("block", F.struct("bound", "block")).alias("block")
    probes = written(tops.groupBy("chunk", "owner").agg(top), "probes")
    first = written(scored(read(probes), asked, blocks, need, dims, kind), "probed")

    def by_place(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct(place, value))).alias(name))

    last = best(first, need).where(F.col("rank") == need)
    raised = F.transform(
        "windows",
        lambda w, i: F.struct(
            w.owner.alias("owner"), F.greatest(w.lo, F.element_at("reached", i)).alias("lo"), w.hi.alias("hi")
        ),
    )
    again = (
        asked.join(by_place(probes, "owner", "block", "probed"), "chunk")
        .join(by_place(last, "window", "score", "reached"), "chunk", "left")
        .select(
            "chunk", "label", "uids", "points", raised.alias("windows"),
            F.transform("uids", lambda _, i: F.coalesce(F.element_at("probed", i), nothing)).alias("probes"),
        )
    )
    again = written(again, "asked-again")
    rest = bounded(again, zones, same_label, dims, kind, probe=False)
    more = scored(read(rest), again, blocks, need, dims, kind)
    return best(first.unionByName(more), need)


# --- mining -------------------------------------------------------------------------------


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor and each of its first ``positives`` rows of its label, the first ``negatives``
    rows of other labels that score from ``low`` to ``high`` hundredths of the positive."""
    chosen = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.col(vector).alias("vector"),
    ).where("label IS NOT NULL AND vector IS NOT NULL")
    dims, largest = extent(chosen, "vector", scale)
    whole = chosen.withColumn("v", quantised(F.col("vector"), scale, largest)).where("v IS NOT NULL")
    kind = number_type(dims, largest)
    blocks = blocks_of(with_keys(whole, dims, largest), dims)
    chunks = anchor_chunks(blocks, dims)
    if chunks.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    anywhere = F.transform(
        "uids",
        lambda _, i: F.struct(i.alias("owner"), F.lit(-ANY).alias("lo"), F.lit(ANY).alias("hi")),
    )
    asked = chunks.drop("ids").withColumn("windows", anywhere)
    near = search(asked, blocks, positives, True, dims, kind)
    least, most = F.expr(f"-floor(-score * {low} / 100BD)"), F.expr(f"floor(score * {high} / 100BD)")
    pairs = near.select(
        "chunk", F.col("window").alias("owner"), "rank", least.cast("long").alias("lo"), most.cast("long").alias("hi"),
        "vec_id", "score",
    ).where("lo <= hi")
    windows = written(
        pairs.groupBy("chunk").agg(
            F.sort_array(F.collect_list(F.struct("owner", "rank", "lo", "hi", "vec_id", "score"))).alias("pairs")
        ),
        "windows",
    )
    window = lambda p: F.struct(p.owner.alias("owner"), p.lo.alias("lo"), p.hi.alias("hi"))
    far = chunks.drop("ids").join(windows.select("chunk", F.transform("pairs", window).alias("windows")), "chunk")
    found = search(far, blocks, negatives, False, dims, kind)
    told = windows.join(chunks.select("chunk", "ids"), "chunk").select(
        "chunk",
        F.inline(
            F.transform(
                "pairs",
                lambda p, i: F.struct(
                    i.alias("window"),
                    F.get("ids", p.owner).alias("anchor_id"),
                    p.vec_id.alias("positive_id"),
                    p.score.alias("positive_score"),
                ),
            )
        ),
    )
    return found.join(told, ["chunk", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
