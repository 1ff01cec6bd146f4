"""Legend, statistics and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.arrays import let, strings
from veilframe.functions.keys import placeholder_category, placeholder_number
from veilframe.operators import rules as R
from veilframe.operators.entities import in_order
from veilframe.operators.external import label_category

EXAMPLES = 3
ANALYZE_EXAMPLES = 5
EXAMPLE_CHARS = 30


def _legend_line(category: Column, unique: Column) -> Column:
    return F.concat(
        F.lit("  "),
        category,
        F.lit("_NNN : "),
        label_category(category, R.CATEGORY_DESCRIPTIONS, "Other"),
        F.lit(" ("),
        unique.cast("string"),
        F.lit(" unique)"),
    )


def _legend(lines: Column) -> Column:
    return F.array_join(F.concat(strings(R.LEGEND_HEAD), lines, strings(R.LEGEND_TAIL)), "\n")


def legend_text_in_row(mapping: Column) -> Column:
    """Legend of one document's mapping entries."""

    def build(cats: Column) -> Column:
        unique = F.array_sort(F.array_distinct(cats))
        return _legend(
            F.transform(
                unique, lambda c: _legend_line(c, F.size(F.filter(cats, lambda x: x == c)))
            )
        )

    return let(
        F.transform(mapping, lambda m: placeholder_category(m["placeholder"])), build
    )


def category_counts(mapping: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return mapping.groupBy(
        *scope, placeholder_category(F.col("placeholder")).alias("category")
    ).agg(F.count(F.lit(1)).alias("unique_values"))


def legend_text(mapping: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Legend of a mapping, one row per scope; a group is the categories."""
    lines = category_counts(mapping, scope).select(
        *scope,
        F.struct(
            "category", _legend_line(F.col("category"), F.col("unique_values")).alias("line")
        ).alias("entry"),
    )
    return lines.groupBy(*scope).agg(
        _legend(
            F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["line"])
        ).alias("legend")
    )


def example_text(placeholder: Column, canonical: Column) -> Column:
    short = F.when(
        F.length(canonical) > EXAMPLE_CHARS,
        F.concat(F.substring(canonical, 1, EXAMPLE_CHARS), F.lit("...")),
    ).otherwise(canonical)
    return F.concat(placeholder, F.lit(" → "), short)


def statistics(mapping: DataFrame) -> DataFrame:
    """Unique values and occurrences per category and in total (``category`` null)
    with the first examples of each category.

    ``row_number() <= k`` is limited on the map side, so no task ever sorts a
    whole category.
    """
    entries = mapping.select(
        placeholder_category(F.col("placeholder")).alias("category"),
        placeholder_number(F.col("placeholder")).alias("num"),
        example_text(F.col("placeholder"), F.col("canonical")).alias("example"),
        "occurrences",
    )
    totals = entries.rollup("category").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("occurrences").alias("occurrences")
    )
    rank = F.row_number().over(Window.partitionBy("category").orderBy("num"))
    examples = (
        entries.withColumn("rank", rank)
        .where(F.col("rank") <= EXAMPLES)
        .groupBy("category")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("num", "example"))),
                    lambda e: e["example"],
                ),
                "; ",
            ).alias("examples")
        )
    )
    return totals.join(F.broadcast(examples), "category", "left")


def analyze(docs_with_spans: DataFrame) -> DataFrame:
    """Per document and category: how many values, and the first five."""
    spans = F.col("spans")
    found = docs_with_spans.select(
        "doc_id",
        F.length("text").alias("characters"),
        F.size("spans").alias("total"),
        let(
            spans,
            lambda all_spans: F.transform(
                F.array_sort(F.array_distinct(F.transform(all_spans, lambda s: s["category"]))),
                lambda c: let(
                    F.filter(all_spans, lambda s: s["category"] == c),
                    lambda mine: F.struct(
                        c.alias("category"),
                        F.size(mine).alias("found"),
                        F.array_join(
                            F.transform(
                                F.slice(mine, 1, ANALYZE_EXAMPLES), lambda s: s["value"]
                            ),
                            "; ",
                        ).alias("examples"),
                    ),
                ),
            ),
        ).alias("by_category"),
    )
    return found.select(
        "doc_id", "characters", "total", F.inline_outer("by_category")
    ).where(F.col("category").isNotNull())


def dry_run(mapping: DataFrame) -> DataFrame:
    """What would be replaced by what, and a last row with the number of entries."""
    total = mapping.agg(F.count(F.lit(1)).cast("string").alias("canonical"))
    return mapping.select("placeholder", "canonical").unionByName(
        total.select(F.lit("TOTAL").alias("placeholder"), "canonical")
    )


def show_mapping(mapping: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Entries for reading, in lexical order of the placeholders (``entry_no``);
    variations only where there are several."""
    listed = mapping
    if "variations" not in mapping.columns and forms is not None:
        several = mapping.where(F.col("n_variations") > 1).select("placeholder")
        listed = mapping.join(
            forms.join(several, "placeholder", "left_semi")
            .groupBy("placeholder")
            .agg(F.array_sort(F.collect_set("value")).alias("variations")),
            "placeholder",
            "left",
        )
    shown = listed.select(
        "placeholder",
        "canonical",
        F.when(F.size("variations") > 1, F.array_join("variations", "; ")).alias("variations"),
        "occurrences",
    )
    return in_order(shown, "placeholder", "entry_no")


def counters(mapping: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Highest number per category (``statistics`` of a stored mapping)."""
    return mapping.groupBy(
        *scope, placeholder_category(F.col("placeholder")).alias("category")
    ).agg(F.max(placeholder_number(F.col("placeholder"))).alias("counter"))


def label_tables(spark) -> DataFrame:
    """Supported labels per back end with their categories, and languages."""
    rows = []
    for backend, table in (
        ("spacy", R.NER_LABELS),
        ("hybrid", R.HYBRID_LABELS),
        ("presidio", R.ANALYZER_LABELS),
        ("gliner", R.ZERO_SHOT_LABELS),
    ):
        rows += [(backend, label, category) for label, category in table.items()]
    rows += [("default_labels", x, x) for x in R.ZERO_SHOT_DEFAULT_LABELS]
    rows += [("extended_labels", x, x) for x in R.ZERO_SHOT_EXTENDED_LABELS]
    rows += [("language", alias, code) for alias, code in R.LANGUAGE_ALIASES.items()]
    rows += [("language", code, code) for code in R.LANGUAGES]
    return spark.createDataFrame(rows, "backend string, label string, category string")
