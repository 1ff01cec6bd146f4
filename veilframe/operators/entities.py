"""Entity resolution: from surface forms to numbered placeholders.

Two scopes.  *Document*: each text has its own mapping, as separate calls do;
everything happens inside the row.  *Corpus*: one mapping is shared by all
texts, as a batch with a shared mapping does; spans are pre-aggregated before
every shuffle and numbers are handed out per range, so that neither a frequent
value nor a large category ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.arrays import let, runs
from veilframe.functions.keys import (
    entity_key,
    placeholder,
    placeholder_category,
    placeholder_number,
)
from veilframe.session import cut_lineage

# --- document scope --------------------------------------------------------------


def keyed_spans(spans: Column) -> Column:
    """Spans from last to first (the order of numbering) with their keys."""
    return F.transform(
        F.reverse(spans),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["category"].alias("category"),
            s["value"].alias("value"),
            entity_key(s["value"], s["category"]).alias("norm_key"),
        ),
    )


ITEM_TYPE = "struct<start:int,end:int,category:string,value:string,norm_key:string>"
ENTRY_TYPE = (
    "struct<placeholder:string,norm_key:string,category:string,num:int,canonical:string,"
    "variations:array<string>,occurrences:int>"
)


def entities_in_row(items: Column, known: Column | None = None) -> Column:
    """Entities in order of first sight, numbered per category, each with its items.

    ``known`` holds entries of an earlier mapping, one a key: they come first, keep
    their numbers, and new ones are numbered after the highest.
    """
    fresh_only = known is None
    if fresh_only:
        known = F.array().cast(f"array<{ENTRY_TYPE}>")
    else:
        known = F.coalesce(known, F.array().cast(f"array<{ENTRY_TYPE}>"))

    def cell(key: Column, at: Column, item: Column, entry: Column) -> Column:
        return F.struct(
            key.alias("norm_key"), at.alias("at"), item.alias("item"), entry.alias("entry")
        )

    no_item, no_entry = F.lit(None).cast(ITEM_TYPE), F.lit(None).cast(ENTRY_TYPE)
    cells = F.concat(
        F.transform(known, lambda e: cell(e["norm_key"], F.lit(-1), no_item, e)),
        F.transform(items, lambda it, i: cell(it["norm_key"], i, it, no_entry)),
    )
    groups = runs(
        F.array_sort(cells), lambda s, i: F.get(s, i)["norm_key"] != F.get(s, i - 1)["norm_key"]
    )

    def entity(group: Column) -> Column:
        first = F.get(group, F.lit(0))
        seen = group if fresh_only else F.filter(group, lambda x: x["at"] >= 0)
        return F.struct(
            first["at"].alias("at"),
            first["norm_key"].alias("norm_key"),
            F.coalesce(first["entry"]["category"], first["item"]["category"]).alias("category"),
            first["entry"].alias("entry"),
            F.coalesce(first["entry"]["canonical"], first["item"]["value"]).alias("canonical"),
            F.transform(seen, lambda x: x["item"]).alias("items"),
        )

    def numbered(ents: Column) -> Column:
        categories = F.array_distinct(F.transform(ents, lambda e: e["category"]))
        return F.transform(categories, lambda c: of_category(ents, c))

    def of_category(ents: Column, category: Column) -> Column:
        mine = F.filter(ents, lambda e: e["category"] == category)
        if fresh_only:
            return F.transform(mine, lambda e, i: entry(e, i + 1))
        return let(mine, after_known)

    def after_known(mine: Column) -> Column:
        old = F.size(F.filter(mine, lambda e: e["entry"].isNotNull()))
        top = F.coalesce(F.array_max(F.transform(mine, lambda e: e["entry"]["num"])), F.lit(0))
        return let(
            F.struct(mine.alias("ents"), (top - old).alias("shift")),
            lambda m: F.transform(m["ents"], lambda e, i: entry(e, m["shift"] + i + 1)),
        )

    def entry(e: Column, fresh: Column) -> Column:
        number = F.coalesce(e["entry"]["num"], fresh)
        return F.struct(
            e["at"].alias("at"),
            e["norm_key"].alias("norm_key"),
            e["category"].alias("category"),
            number.alias("num"),
            F.coalesce(e["entry"]["placeholder"], placeholder(e["category"], number)).alias(
                "placeholder"
            ),
            e["canonical"].alias("canonical"),
            e["entry"].alias("entry"),
            e["items"].alias("items"),
        )

    found = F.array_sort(F.transform(groups, entity))
    return F.array_sort(F.flatten(let(found, numbered)))


def mapping_in_row(entities: Column) -> Column:
    """Mapping entries of a document: known ones, then new ones in order of creation."""
    none = F.array().cast("array<string>")
    return F.transform(
        entities,
        lambda e: F.struct(
            e["placeholder"].alias("placeholder"),
            e["norm_key"].alias("norm_key"),
            e["category"].alias("category"),
            e["num"].alias("num"),
            e["canonical"].alias("canonical"),
            F.array_sort(
                F.array_distinct(
                    F.concat(
                        F.coalesce(e["entry"]["variations"], none),
                        F.transform(e["items"], lambda i: i["value"]),
                    )
                )
            ).alias("variations"),
            (F.coalesce(e["entry"]["occurrences"], F.lit(0)) + F.size(e["items"])).alias(
                "occurrences"
            ),
        ),
    )


def edits_in_row(entities: Column) -> Column:
    """The items of all entities with their placeholder, in text order."""
    return F.array_sort(
        F.flatten(
            F.transform(
                entities,
                lambda e: F.transform(
                    e["items"],
                    lambda i: F.struct(
                        i["start"].alias("start"),
                        i["end"].alias("end"),
                        e["placeholder"].alias("replacement"),
                    ),
                ),
            )
        )
    )


# --- corpus scope ----------------------------------------------------------------


def with_key(spans: DataFrame) -> DataFrame:
    return spans.withColumn("norm_key", entity_key(F.col("value"), F.col("category")))


def surface_forms(
    spans: DataFrame, scope: Sequence[str] = (), row: str | None = None
) -> DataFrame:
    """Distinct surface forms per key, with counts and first sight.

    The order of first sight is document order, and last to first inside a
    document; ``row`` orders documents that share an id.  A frequent form is counted
    on the map side.
    """
    first = F.struct(
        F.col("doc_id"),
        (F.col(row) if row else F.lit(0).cast("long")).alias("row"),
        (-F.col("start")).alias("from_end"),
        F.col("category"),
    )
    return (
        with_key(spans)
        .groupBy(*scope, "norm_key", "value")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min(first).alias("first"))
    )


def entities(forms: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per key: canonical form and category are those seen first."""
    return (
        forms.groupBy(*scope, "norm_key")
        .agg(
            F.min(F.struct("first", "value")).alias("seen"),
            F.sum("occurrences").alias("occurrences"),
            F.count(F.lit(1)).alias("n_variations"),
        )
        .select(
            *scope,
            "norm_key",
            F.col("seen.first.category").alias("category"),
            F.col("seen.value").alias("canonical"),
            F.col("seen.first.doc_id").alias("first_doc"),
            F.col("seen.first.row").alias("first_row"),
            F.col("seen.first.from_end").alias("first_from_end"),
            "occurrences",
            "n_variations",
        )
    )


def number_entities(ents: DataFrame, start_at: DataFrame | None = None) -> DataFrame:
    """Number entities per category in order of first sight, across all tasks.

    The rows are range-partitioned by (category, first sight) and pinned; each
    range counts its rows, running sums of those few counts give every range its
    offset, and ranks inside a range complete the number.  No task ever holds
    more than one range, however large a category is.  ``start_at`` gives the
    highest number already in use per category.
    """
    order = ["first_doc", "first_row", "first_from_end"]
    ranged = ents.repartitionByRange("category", *order).select(
        "*", F.spark_partition_id().alias("slot")
    )
    # Sampling decides the ranges, so both uses below have to read one copy.
    ranged = cut_lineage(ranged)
    offsets = (
        ranged.groupBy("category", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "category",
            "slot",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("category")
                    .orderBy("slot")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("offset"),
        )
    )
    if start_at is not None:
        offsets = offsets.join(start_at, "category", "left").withColumn(
            "offset", F.col("offset") + F.coalesce(F.col("max_num"), F.lit(0))
        ).drop("max_num")
    rank = F.row_number().over(Window.partitionBy("category", "slot").orderBy(*order))
    return (
        ranged.withColumn("rank", rank)
        # One row per category and range: bounded by the number of partitions.
        .join(F.broadcast(offsets), ["category", "slot"])
        .withColumn("num", F.col("offset") + F.col("rank"))
        .withColumn("placeholder", placeholder(F.col("category"), F.col("num")))
        .withColumn("is_lookup", F.lit(True))
        .drop("slot", "rank", "offset")
    )


def in_order(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Rows numbered from 1 in the order of a column without ties, range by range."""
    ranged = cut_lineage(
        rows.repartitionByRange(key).withColumn("slot", F.spark_partition_id())
    )
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    offsets = counts.select("slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(key))
    return (
        ranged.join(F.broadcast(offsets), "slot")
        .withColumn(number, F.col("offset") + rank)
        .drop("slot", "offset")
    )


def build_mapping(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping of a corpus and its table of surface forms."""
    forms = cut_lineage(surface_forms(spans))
    mapping = cut_lineage(number_entities(entities(forms)))
    return mapping, placed_forms(forms, mapping)


MAPPING_COLUMNS = (
    "norm_key", "category", "num", "placeholder", "canonical", "occurrences", "n_variations",
    "is_lookup",
)
FORM_COLUMNS = ("placeholder", "norm_key", "value", "occurrences")


def placed_forms(forms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Surface forms with the placeholder their key is looked up under."""
    names = mapping.where("is_lookup").select("norm_key", "placeholder")
    return forms.drop("placeholder").join(names, "norm_key").select(*FORM_COLUMNS)


def extend_mapping(
    mapping: DataFrame,
    forms: DataFrame,
    known_forms: DataFrame,
    top: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Grow a mapping by a batch: known keys keep their placeholder and gain
    occurrences, new keys are numbered after the highest number in use.

    ``mapping`` comes from ``build_mapping``, an earlier extension or stored
    entries, ``known_forms`` from the same place (``stored_forms`` of entries); of
    stored entries that share a key only the look-up one is matched.  Returns the
    mapping and its surface forms; entries the batch does not touch, and their
    forms, come back as they were.  ``top(category, max_num)`` gives the highest numbers
    in use where ``mapping`` is a part of all entries.
    """
    batch = entities(forms)
    if top is None:
        top = mapping.groupBy("category").agg(F.max("num").alias("max_num"))
    lookups = mapping.where("is_lookup")
    fresh = number_entities(batch.join(lookups.select("norm_key"), "norm_key", "left_anti"), top)
    seen = batch.select("norm_key", F.col("occurrences").alias("more"))
    grown = cut_lineage(
        lookups.select(*MAPPING_COLUMNS)
        .join(seen, "norm_key", "left")
        .withColumn("occurrences", F.col("occurrences") + F.coalesce("more", F.lit(0)))
        .select(*MAPPING_COLUMNS)
        .unionByName(fresh.select(*MAPPING_COLUMNS))
        .unionByName(mapping.where("NOT is_lookup").select(*MAPPING_COLUMNS))
    )
    all_forms = cut_lineage(
        placed_forms(forms, grown)
        .unionByName(known_forms.select(*FORM_COLUMNS))
        .groupBy("placeholder", "norm_key", "value")
        .agg(F.sum("occurrences").alias("occurrences"))
    )
    sizes = all_forms.groupBy("placeholder").agg(F.count(F.lit(1)).alias("all_variations"))
    counted = (
        grown.join(sizes, "placeholder", "left")
        .withColumn("n_variations", F.coalesce("all_variations", "n_variations"))
        .select(*MAPPING_COLUMNS)
    )
    return counted, all_forms.select(*FORM_COLUMNS)


def stored_forms(entries: DataFrame) -> DataFrame:
    """Surface forms of stored entries, each under its own placeholder; how often each
    occurred is not stored."""
    return entries.select(
        "placeholder",
        "norm_key",
        F.explode(F.array_distinct("variations")).alias("value"),
        F.lit(0).cast("long").alias("occurrences"),
    )


def mapping_from_entries(entries: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Mapping rebuilt from stored entries (``placeholder, canonical, variations,
    occurrences`` and ``entry_no``, the place in the file).

    Keys come from the canonical form alone, the category from the placeholder;
    if two entries give one key, the later one answers look-ups (``is_lookup``).
    """
    parsed = (
        entries.withColumn("category", placeholder_category(F.col("placeholder")))
        .withColumn("num", placeholder_number(F.col("placeholder")))
        .withColumn("norm_key", entity_key(F.col("canonical"), F.col("category")))
        .withColumn("n_variations", F.size("variations").cast("long"))
    )
    last = F.max("entry_no").over(Window.partitionBy(*scope, "norm_key"))
    return parsed.withColumn("is_lookup", F.col("entry_no") == last)


def lookup(
    rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None
) -> DataFrame:
    """Left join of many rows with a table that has one row per key.

    Keys that hold more than a quarter of a task's fair share of the rows are joined
    by broadcast (there can be no more than four for each task), the others by a
    shuffle in which no key is large.  ``counts(key, n)`` saves counting the rows.
    ``rows`` is read twice: pass a table or a pinned DataFrame.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col(key).isNotNull())
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = counts.agg((F.sum("n") / (4 * tasks)).alias("limit"))
    hot = cut_lineage(
        counts.crossJoin(F.broadcast(limit)).where(F.col("n") > F.col("limit")).select(key)
    )
    hot_table = table.join(F.broadcast(hot), key, "left_semi")
    by_broadcast = rows.join(F.broadcast(hot), key, "left_semi").join(
        F.broadcast(hot_table), key, "left"
    )
    by_shuffle = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return by_broadcast.unionByName(by_shuffle)
