"""Benchmark passages in documents, by a distributed positional inverted index.

The index holds one posting (row, pos, term) for each document word that is a word of
the benchmark, written by the tasks that read the texts, and one header row for each
document; all later steps read the index and no text.  A window of ten item words is
looked up from its rarest word: the postings of that word, moved by its place in the
item, are the candidate places; they are met with the moved postings of the second
rarest word, and what is left with those of all the others.

* Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z in
  lower case.  An item of fewer than ten words, but not none, is one window.
* Null and empty texts, of documents or items, have no words and are never hit.  A null
  item id counts as an empty one; items with equal ids count once.
* Texts are read whole; beyond the task that reads it, a very long one is postings like
  others.  Words that tie in rarity go by their place in the window, which changes the work
  and no result.
* Documents that repeat are hit alike, and each has its own row.  Empty tables give no
  hits.  Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import checked_broadcast, discard, lower_ascii, written

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SLOP = 5  # words more than a window's size that its words may stand from the rarest one
HASH_SALT = "second"


def words_of(text: Column) -> Column:
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.array_remove(cut, "")


@dataclass(frozen=True)
class Items:
    """ids: item, item_id; words: item, n, at, word, term; terms: word, term."""

    ids: DataFrame
    words: DataFrame
    terms: DataFrame


def read_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Items:
    rows = written(
        benchmark.select(
            F.monotonically_increasing_id().alias("item"),
            F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"),
            words_of(F.col(text)).alias("words"),
        ).where(F.size("words") > 0),
        "items",
    )
    words = rows.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    terms = written(
        words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms"
    )
    return Items(rows.select("item", "item_id"), written(words.join(terms, "word"), "item-words"), terms)


def build_index(
    docs: DataFrame, terms: DataFrame, row: Column, text: str = "text", **carried: Column
) -> DataFrame:
    """Postings (row, pos, term) of the terms, and for each document a header with
    null term, its number of words and the carried columns."""
    cut = docs.select(row.alias("row"), words_of(F.col(text)).alias("words"), *[c.alias(n) for n, c in carried.items()])
    cells = cut.select(
        "row",
        *carried,
        F.size("words").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("at", "cell"),
    )
    header = F.col("at") == 0
    known = checked_broadcast(terms.select(F.col("word").alias("cell"), "term"))
    found = cells.join(known, "cell", "left").where(header | F.col("term").isNotNull())
    return written(
        found.select(
            "row",
            (F.col("at") - 1).alias("pos"),
            "term",
            *[F.when(header, F.col(n)).alias(n) for n in ("n_words", *carried)],
        ),
        "postings",
    )


def postings_of(index: DataFrame) -> DataFrame:
    return index.where(F.col("term").isNotNull()).select("row", "pos", "term")


def ranked_windows(index: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """item, start, size, words (from the rarest in the corpus: freq, at, term)."""
    often = postings_of(index).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    size = F.least(F.col("n"), F.lit(window))
    first = F.greatest(F.col("at") - size + 1, F.lit(0))
    last = F.least(F.col("at"), F.col("n") - size)
    rated = items.words.join(often, "term", "left").select(
        "item", F.coalesce("freq", F.lit(0)).alias("freq"), "at", "term", size.alias("size"),
        F.explode(F.sequence(first, last)).alias("start"),
    )
    ranked = rated.groupBy("item", "start").agg(
        F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("freq", "at", "term"))).alias("words"),  # 10 at most
    )
    return written(ranked, "windows")


def phrase_matches(index: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """row, item, first, last: stretches of document words (ends included) made of
    windows of the item that occur in full."""
    windows = ranked_windows(index, items, window).where(F.col("words")[0]["freq"] > 0)
    places = windows.select(
        "item", "start", "size",
        F.col("words")[0]["at"].alias("at1"), F.col("words")[0]["term"].alias("term"),
        F.get("words", F.lit(1))["at"].alias("at2"), F.get("words", F.lit(1))["term"].alias("term2"),
    )
    pairs = places.select("item", "at1", "term", "at2", "term2").distinct()
    rarest = postings_of(index).join(checked_broadcast(pairs), "term").select(
        "row", "item", (F.col("pos") - F.col("at1")).alias("shift"), "at1", "at2", "term2"
    ).where("shift + coalesce(at2, 0) >= 0")
    rarest = written(rarest, "candidates")

    wanted = rarest.where("term2 IS NOT NULL").withColumn("pos", F.col("shift") + F.col("at2"))
    seconds = postings_of(index).withColumnRenamed("term", "term2").join(
        checked_broadcast(pairs.select("term2").distinct()), "term2", "left_semi"
    )
    both = wanted.join(seconds, ["row", "pos", "term2"], "left_semi")
    met = both.drop("pos").unionByName(rarest.where("term2 IS NULL"))

    keys = ["item", "at1", "at2"]
    wide = places.select(*[F.col(k).alias(f"w_{k}") for k in keys], "start", "size")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at")
    asked = met.join(checked_broadcast(wide), same).select("row", "item", "shift", "size", at).distinct()
    asked = written(
        asked.join(checked_broadcast(items.words.select("item", "at", "term")), ["item", "at"])
        .withColumn("pos", F.col("shift") + F.col("at")),
        "asked",
    )
    near = postings_of(index).join(
        checked_broadcast(asked.select("row").distinct()), "row", "left_semi"
    )
    matched = asked.join(near, ["row", "pos", "term"], "left_semi")

    line = Window.partitionBy("row", "item", "shift").orderBy("at")
    runs = matched.withColumn("run", F.col("at") - F.row_number().over(line))
    return (
        runs.groupBy("row", "item", "shift", "run")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("size").alias("size"))
        .where("last - first + 1 >= size")
        .select("row", "item", "first", "last")
    )


def _close(index: DataFrame, asked: DataFrame, block: int, reach: Column) -> DataFrame:
    """The rows of ``asked`` (row, centre, term, ...) with each posting of their term at
    most ``reach`` words from the centre; blocks of words keep common words of long texts
    from meeting all their places."""
    blocks = F.sequence(
        F.floor((F.col("centre") - reach) / block), F.floor((F.col("centre") + reach) / block)
    )
    placed = postings_of(index).withColumn("block", F.floor(F.col("pos") / block))
    met = asked.withColumn("block", F.explode(blocks)).join(placed, ["row", "block", "term"])
    return met.where(F.abs(F.col("pos") - F.col("centre")) <= reach)


def proximity_matches(
    index: DataFrame, items: Items, slop: int, window: int = WINDOW
) -> DataFrame:
    """row, item, start, pos: windows all of whose words, each as often as in the window,
    stand in any order within ``slop`` words more than the window's size of its rarest
    word at ``pos``.  Places without the second rarest word nearby go first."""
    block = window + slop
    reach = F.col("size") + (slop - 1)
    windows = ranked_windows(index, items, window).where(F.col("words")[0]["freq"] > 0)
    terms = F.array_distinct("words.term")
    wide = windows.select(
        "item", "start", "size", F.col("words.term").alias("all"), terms.alias("terms"),
        terms[0].alias("rarest"), F.get(terms, F.lit(1)).alias("second"),
    )
    pairs = wide.select("item", "size", "rarest", "second").distinct()
    places = written(
        postings_of(index).join(checked_broadcast(pairs.withColumn("term", F.col("rarest"))), "term").select(
            "row", "item", "size", F.col("pos").alias("centre"), "rarest", "second"
        ),
        "places",
    )
    seconds = places.where("second IS NOT NULL").withColumn("term", F.col("second"))
    both = _close(index, seconds, block, reach).select(*places.columns).distinct()
    met = written(both.union(places.where("second IS NULL")), "met")

    keys = ["item", "size", "rarest", "second"]
    named = wide.select(*[F.col(k).alias(f"w_{k}") for k in keys], "start", "all", "terms")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    wanted = F.explode(
        F.transform(
            "terms",
            lambda t: F.struct(t.alias("term"), F.size(F.filter("all", lambda x: x == t)).alias("need")),
        )
    )
    asked = met.join(checked_broadcast(named), same).select(
        "row", "item", "start", "size", "centre", F.size("terms").alias("n_terms"), wanted.alias("wanted")
    )
    asked = written(asked.select("*", "wanted.*").drop("wanted"), "asked")
    case = ["row", "item", "start", "centre", "n_terms"]
    return (
        _close(index, asked, block, reach)
        .groupBy(*case, "term", "need")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= need")
        .groupBy(*case)
        .agg(F.count(F.lit(1)).alias("met"))
        .where("met = n_terms")
        .select("row", "item", "start", F.col("centre").alias("pos"))
    )


def report(index: DataFrame, items: Items, matches: DataFrame) -> DataFrame:
    """One row a document: the header's columns, n_hit, item_ids (distinct, sorted)."""
    line = Window.partitionBy("row").orderBy("first", "last")
    earlier = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(
        F.lit(0), F.col("last") - F.greatest("first", F.coalesce(earlier + 1, F.lit(0))) + 1
    )
    stretches = matches.withColumn("fresh", fresh)
    hits = stretches.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = matches.select("row", "item").distinct().join(checked_broadcast(items.ids), "item")
    ids = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    headers = index.where(F.col("term").isNull()).drop("pos", "term")
    return (
        headers.join(hits, "row", "left")
        .join(ids, "row", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids of every document."""
    items = read_items(benchmark)
    index = build_index(docs, items.terms, F.monotonically_increasing_id(), doc_id=F.col(doc_id))
    matches = written(phrase_matches(index, items), "matches")
    return report(index, items, matches).select("doc_id", "n_words", "n_hit", "item_ids")


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_near (windows at places), item_ids of every document."""
    items = read_items(benchmark)
    index = build_index(docs, items.terms, F.monotonically_increasing_id(), doc_id=F.col(doc_id))
    matches = written(proximity_matches(index, items, slop), "near")
    spots = matches.withColumnsRenamed({"pos": "first"}).withColumn("last", F.col("first"))
    near = matches.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    told = report(index, items, spots).join(near, "row", "left")
    return told.select("doc_id", "n_words", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, unchanged.

    Whether a text is hit depends on the text alone, so texts are known by 128 bits of
    hash and no row has to be pinned."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(text)}"
    keys = {"k1": F.xxhash64(at), "k2": F.xxhash64(F.lit(HASH_SALT), F.col(at))}
    items = read_items(benchmark)
    index = build_index(plain, items.terms, F.monotonically_increasing_id(), text=at, **keys)
    rows = phrase_matches(index, items).select("row").distinct()
    headers = index.where(F.col("term").isNull()).select("row", *keys)
    hit = written(headers.join(checked_broadcast(written(rows, "rows")), "row", "left_semi").select(*keys).distinct(), "hit")
    discard(index)
    clean = plain.withColumns(keys).join(checked_broadcast(hit), list(keys), "left_anti")
    return clean.select(*plain.columns).toDF(*docs.columns)
