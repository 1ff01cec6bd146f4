"""Spans found by models outside the engine.

A model's result is a table ``doc_id, start, end, label, score, lang`` or an
array column of the same fields made by ``spans_from_model`` in the row of its
text.  The functions below turn such an array into spans by each back end's
label table and rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.arrays import let
from veilframe.functions.text import strip
from veilframe.operators import rules as R
from veilframe.session import ROW, pin_rows

#: Columns of a table of spans.
SPAN_FIELDS = ("doc_id", "start", "end", "label", "score", "lang")
EXTERNAL_TYPE = "struct<start:int,end:int,label:string,score:double,lang:string>"


def check_external(docs: DataFrame, external: DataFrame) -> None:
    """Spans that name no document, or one of several, would leave a text as it is or
    cut it at the wrong places: refuse them."""
    if external.where("doc_id IS NULL").limit(1).count():
        raise ValueError("external spans without a doc_id")
    if docs.isStreaming:
        return
    named = docs.join(external.select("doc_id").distinct(), "doc_id", "left_semi")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("external spans for a doc_id that several documents have")


def attach_external(docs: DataFrame, external: DataFrame) -> DataFrame:
    """Documents with their external spans as array column ``external``.

    One exchange by ``doc_id`` (none if both are bucketed by it); a group is
    the spans of one document.  The spans are pinned first: a model that was not pinned
    would run over all texts for each of the two checks, and once more for the join.
    """
    external = pin_rows(external.select(*SPAN_FIELDS)).drop(ROW)
    check_external(docs, external)
    grouped = external.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("start").cast("int").alias("start"),
                    F.col("end").cast("int").alias("end"),
                    F.col("label").alias("label"),
                    F.col("score").cast("double").alias("score"),
                    F.col("lang").alias("lang"),
                )
            )
        ).alias("external")
    )
    none = F.array().cast(f"array<{EXTERNAL_TYPE}>")
    return docs.join(grouped, "doc_id", "left").withColumn(
        "external", F.coalesce("external", none)
    )


def spans_from_model(
    docs: DataFrame, load: Callable[[], Callable[[str], list[dict]]]
) -> DataFrame:
    """Run a model over the texts; ``load`` is called once per Python worker batch
    stream and returns ``predict(text) -> [{start, end, label, score, lang}]``.
    Only texts go to the model, in batches that Spark bounds by rows and bytes; the
    spans come back in the row of their text, so no join is needed."""
    fields = ("start", "end", "label", "score", "lang")

    @F.pandas_udf(f"array<{EXTERNAL_TYPE}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            yield pd.Series(
                [
                    [{k: hit.get(k) for k in fields} for hit in (predict(t) if t else [])]
                    for t in texts
                ],
                dtype=object,
            )

    return docs.withColumn("external", found(F.col("text")))


def register_model(
    spark: SparkSession, name: str, load: Callable[[], Callable[[str], list[dict]]]
) -> None:
    """Register a model as a table function for SQL.

    ``name(text, offset)`` returns a row ``start, end, label, score, lang`` for each span,
    moved by ``offset``; with chunks of the texts and where each begins::

        SELECT c.doc_id, m.* FROM chunks c, LATERAL name(c.text, c.chunk_start) m

    gives a table of external spans, and the model never sees more than a chunk.  ``load``
    is called when a task meets its first text, as in ``spans_from_model``; null and empty
    texts have no spans, a null offset counts as 0.
    """
    fields = ("label", "score", "lang")

    @F.udtf(returnType="start int, end int, label string, score double, lang string")
    class ModelSpans:
        def __init__(self) -> None:
            self.predict = None

        def eval(self, text: str | None, offset: int | None) -> Iterator[tuple]:
            if not text:
                return
            if self.predict is None:
                self.predict = load()
            for hit in self.predict(text):
                shift = offset or 0
                yield (hit["start"] + shift, hit["end"] + shift, *(hit.get(f) for f in fields))

    spark.udtf.register(name, ModelSpans)


def label_category(
    label: Column, table: Mapping[str, str], default: str | None = None
) -> Column:
    """Category of a label; the table is a constant of a few dozen entries."""
    constant = F.expr(f"map({S.literals([x for pair in table.items() for x in pair])})")
    found = F.try_element_at(constant, label)
    return found if default is None else F.coalesce(found, F.lit(default))


def _as_spans(
    text: Column, external: Column, category: Callable[[Column], Column], confidence: float | None
) -> Column:
    def one(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            category(x).alias("category"),
            (x["score"] if confidence is None else F.lit(confidence)).cast("double").alias(
                "confidence"
            ),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("value"),
            (x["start"] - 20).alias("ctx_from"),
            (x["end"] + 20).alias("ctx_to"),
        )

    return F.transform(external, one)


def ner_spans(
    text: Column,
    external: Column,
    categories: Sequence[str] | None = None,
    include_dates: bool = False,
) -> Column:
    """Named entities: mapped labels, wanted categories, no tiny or broken ones."""
    if categories is None:
        categories = R.NER_DEFAULT_CATEGORIES + (("DATE",) if include_dates else ())
    found = _as_spans(
        text, external, lambda x: label_category(x["label"], R.NER_LABELS, "MISC"), 0.90
    )
    return S.first_per_place(
        F.filter(
            found,
            lambda s: s["category"].isin(list(categories))
            & (F.length(strip(s["value"])) >= 2)
            & ~F.contains(s["value"], F.lit("\n")),
        )
    )


def of_languages(external: Column, languages: Sequence[str]) -> Column:
    """Spans of these languages' models, those of the first language first."""

    def of_language(code: str) -> Column:
        return F.filter(external, lambda x: x["lang"] == code)

    return F.concat(*[of_language(code) for code in languages])


def ner_spans_multi(
    text: Column,
    external: Column,
    languages: Sequence[str],
    categories: Sequence[str] | None = None,
) -> Column:
    """Entities of several languages' models; at one place the first language wins."""
    return F.array_sort(ner_spans(text, of_languages(external, languages), categories))


def plausible_entities(text: Column, external: Column, include_org: bool = False) -> Column:
    """Entities that may stand beside pattern spans."""
    wanted = ["PERSON", "PLACE"] + (["ORG"] if include_org else [])
    found = _as_spans(
        text, external, lambda x: label_category(x["label"], R.HYBRID_LABELS), 0.90
    )
    return F.filter(
        found,
        lambda s: F.coalesce(s["category"].isin(wanted), F.lit(False))
        & (F.length(strip(s["value"])) >= 2)
        & ~F.contains(s["value"], F.lit("@"))
        & (F.lower(s["value"]) != "email"),
    )


def hybrid_extra(
    text: Column, external: Column, pattern_spans: Column, include_org: bool = False
) -> Column:
    """Entities that overlap no pattern span and no earlier kept entity."""
    return S.keep_free(plausible_entities(text, external, include_org), pattern_spans)


def analyzer_spans(
    text: Column,
    external: Column,
    entities: Sequence[str] | None = None,
    score_threshold: float = 0.5,
) -> Column:
    """Spans of an analyzer with own scores; overlaps stay."""
    wanted = F.filter(
        external,
        lambda x: (x["score"] >= score_threshold)
        & (F.lit(True) if entities is None else x["label"].isin(list(entities))),
    )
    return F.array_sort(
        _as_spans(
            text, wanted, lambda x: label_category(x["label"], R.ANALYZER_LABELS, "MISC"), None
        )
    )


def zero_shot_spans(
    text: Column,
    external: Column,
    labels: Sequence[str] | None = None,
    extended: bool = False,
    threshold: float = 0.5,
    flat: bool = True,
) -> Column:
    """Spans of a zero-shot model for the requested labels; ``flat`` keeps the
    best-scored of overlapping ones."""
    if labels is None:
        labels = R.ZERO_SHOT_EXTENDED_LABELS if extended else R.ZERO_SHOT_DEFAULT_LABELS
    wanted = F.filter(
        external, lambda x: (x["score"] >= threshold) & x["label"].isin(list(labels))
    )
    found = _as_spans(
        text,
        wanted,
        lambda x: label_category(F.lower(x["label"]), R.ZERO_SHOT_LABELS, "MISC"),
        None,
    )
    return let(found, S.resolve_overlaps) if flat else F.array_sort(found)


def language_code(language: Column) -> Column:
    """ISO code of a language code or name; null if it is not known."""
    cleaned = F.lower(strip(language))
    table = {**{c: c for c in R.LANGUAGES}, **R.LANGUAGE_ALIASES}
    return label_category(cleaned, table)


def known_language(language: str) -> str | None:
    cleaned = language.strip().lower()
    code = R.LANGUAGE_ALIASES.get(cleaned, cleaned)
    return code if code in R.LANGUAGES else None


def require_language(language: str) -> str:
    """Driver-side check of one language option."""
    code = known_language(language)
    if code is None:
        raise ValueError(f"Unknown language: {language}. Supported: {', '.join(R.LANGUAGES)}")
    return code
