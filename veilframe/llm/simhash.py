"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits over 3-word shingles; two link when at most two bits differ.
The bits are cut into a ring of three segments.  If two fingerprints differ in at most
two bits, there is a segment from which the differences of the next 1, 2 and 3
segments stay within the proportional budgets 0, 1 and 2.  So candidates share a whole
segment (a join key), the chain check prunes those whose next segment differs by more
than one bit, and only the rest are compared in full.

Only distinct fingerprints take part, and a segment value held by many of them
(``BUCKET``) is not joined with itself: its members are linked through the strings one
bit away from each.  Two members within two bits share such a string, and two that
share one are within two bits, so the links are the same, and no string has more
members than bits.  Components come from rounds of star contraction on tables.

* No words, an empty or a null text: fingerprint zero, linked like any other.
* A null doc_id never is a component's id unless all its documents lack one.
* Shingles of whole texts are counted, a text at a time, so a very long one needs memory for
  its own words.  Ties in a bit (set in just half the hashes) give 0.
* Rows that repeat link to each other; an empty table gives an empty result.
* The operators take the names of their columns and return columns of their own, so
  other columns of the input cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import checked_broadcast, discard, stored, written

SHINGLE = 3
HASH_SEED = 42
BITS = 2  # most differing bits of a link

#: First bit (from the lowest) and width of each segment of the ring.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Differences allowed over the first 1, 2 and 3 segments of a chain.
BUDGETS = tuple(BITS * (i + 1) // len(SEGMENTS) for i in range(len(SEGMENTS)))
#: Distinct fingerprints with one segment value that are compared with each other.
BUCKET = 64

BLOCK = 8192  # shingles whose bits are counted at once


def fingerprint_of(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # both touch ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % s for s in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), BLOCK):
        some = shingles[i : i + BLOCK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in some), ">u8", len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        bits = np.fromiter((fingerprint_of(t) for t in texts), np.uint64, len(texts))
        return pd.Series(bits.view(np.int64))

    return prints(text.cast("binary"))


def hex_digits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


# --- links ----------------------------------------------------------------------------


def _part(bits: Column, segment: int) -> Column:
    first, width = SEGMENTS[segment % len(SEGMENTS)]
    return F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``bits`` that connect all fingerprints
    within BITS of each other; every pair is such a link."""
    keyed = prints.select(
        "bits",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("segment"), _part(F.col("bits"), i).alias("value"))
                    for i in range(len(SEGMENTS))
                ]
            )
        ).alias("key"),
    ).select("key.segment", "key.value", "bits")
    keyed = written(keyed, "segments")
    sizes = keyed.groupBy("segment", "value").count().where("count > 1")
    sizes = written(sizes, "buckets")
    few, many = sizes.where(F.col("count") <= BUCKET), sizes.where(F.col("count") > BUCKET)
    return chained_pairs(keyed, few).union(shared_neighbours(keyed, many)).distinct()


def chained_pairs(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    key = ["segment", "value"]
    rows = keyed.join(buckets.select(*key), key)
    a, b = rows.withColumnRenamed("bits", "a"), rows.withColumnRenamed("bits", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(len(SEGMENTS)):
        second = F.bit_count(_part(differing, i + 1)) <= BUDGETS[1]
        chain = chain | ((F.col("segment") == i) & second)
    return (
        a.join(b, key)
        .where("a < b")
        .where(chain)
        .where(F.bit_count(differing) <= BUDGETS[2])
        .select("a", "b")
    )


def shared_neighbours(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    key = ["segment", "value"]
    near = None
    for i, (first, width) in enumerate(SEGMENTS):
        free = [b for b in range(64) if not first <= b < first + width]
        flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in free])
        hot = buckets.where(F.col("segment") == i).select(*key)
        rows = keyed.join(hot, key).select(
            "segment", "bits", F.explode(flips).alias("flip")
        ).select("segment", "bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("hub"))
        near = rows if near is None else near.union(rows)
    first_of = F.min("bits").over(Window.partitionBy("segment", "hub"))
    return (
        near.withColumn("a", first_of).where("a < bits").select("a", F.col("bits").alias("b"))
    )


# --- components ------------------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes in ``pairs`` (a, b).

    Large stars hang a node's larger neighbours on its smallest, small stars its
    smaller ones; when a round changes nothing, the pairs are stars."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        earlier, edges = edges, written(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "small-stars",
        )
        discard(earlier)
        discard(large)
        sign = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if sign == seen:
            break
        seen = sign
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def classes(prints: DataFrame) -> DataFrame:
    """bits, root: the class of every distinct fingerprint of ``prints`` (bits)."""
    own = written(prints.select("bits").distinct(), "distinct-prints")
    found = components(links(own))
    return own.join(found, own.bits == found.node, "left").select(
        "bits", F.coalesce("root", "bits").alias("root")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits, component_id: one row for each row of the input."""
    prints = written(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("bits")),
        "fingerprints",
    )
    of_bits = prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    of_bits = written(of_bits, "print-ids")
    named = written(classes(of_bits).join(of_bits, "bits"), "classes")
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classed = named.join(firsts, "root").select("bits", "component_id")
    return prints.join(classed, "bits").select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest doc_id
    (null last), and of equal ids one."""
    kept = stored(docs, "near-duplicate-input")
    prints = written(
        kept.rows.select(
            F.struct(
                F.col(kept.at(doc_id)).isNull().alias("no_id"),
                F.col(kept.at(doc_id)).alias("doc_id"),
                F.col("_rid").alias("rid"),
            ).alias("rank"),
            fingerprint(F.col(kept.at(text))).alias("bits"),
        ),
        "fingerprints",
    )
    of_bits = written(prints.groupBy("bits").agg(F.min("rank").alias("rank")), "print-ids")
    first = classes(of_bits).join(of_bits, "bits").groupBy("root").agg(F.min("rank").alias("rank"))
    rid = F.col("rank.rid").alias("_rid")
    leaving = written(prints.select(rid).join(first.select(rid), "_rid", "left_anti"), "leaving")
    return kept.original(kept.rows.join(checked_broadcast(leaving), "_rid", "left_anti"))
