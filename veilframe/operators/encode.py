"""Encode: detect, resolve, anonymise and rewrite documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.arrays import explode_structs
from veilframe.functions.rewrite import splice
from veilframe.functions.strategies import strategy_fn
from veilframe.functions.text import join_broken_names
from veilframe.operators import detectors as D
from veilframe.operators import entities as E
from veilframe.operators import external as X
from veilframe.operators import pieces as PC
from veilframe.operators.reports import legend_text_in_row, legend_text
from veilframe.session import ROW, cut_lineage, pin_rows

if TYPE_CHECKING:
    from veilframe.sources.store import MappingStore

#: Flag of the texts that are scanned in pieces.
LARGE = "_large_text"

BACKENDS = ("hybrid", "patterns", "spacy", "presidio", "gliner", "auto")


@dataclass
class Encoded:
    """Sanitised documents, the mapping that restores them, its surface forms, and
    those of them that these documents hold, with how often they do."""

    documents: DataFrame
    mapping: DataFrame | None = None
    forms: DataFrame | None = None
    seen: DataFrame | None = None


def resolve_backend(backend: str) -> str:
    """``auto`` means the hybrid back end; without external spans that is the
    pattern part alone."""
    if backend not in BACKENDS:
        raise ValueError(f"Unknown backend: {backend}")
    return "hybrid" if backend == "auto" else backend


def languages(language: str | Sequence[str], backend: str) -> list[str]:
    """Codes of the languages asked for."""
    asked = [language] if isinstance(language, str) else list(language)
    if backend != "hybrid":
        return [X.require_language(x) for x in asked]
    return [X.known_language(x) or "en" for x in asked]


def detect_spans(
    docs: DataFrame,
    backend: str = "patterns",
    external: DataFrame | None = None,
    language: str | Sequence[str] | None = None,
    **options: Any,
) -> DataFrame:
    """Documents with array column ``spans``: disjoint, in text order.

    ``language`` names the model (or models, the first wins a place) whose spans are
    used.  An unknown one is an error, but for the hybrid back end, which falls back to
    English.

    Finding and choosing are columns of their own, which keeps the expressions short;
    they are one projection again when the plan runs.
    """
    backend = resolve_backend(backend)
    if external is not None:
        docs = X.attach_external(docs, external)
    has_external = "external" in docs.columns
    text, given = F.col("text"), F.col("external")
    if language is not None and has_external:
        docs = docs.withColumn("external", X.of_languages(given, languages(language, backend)))
    if backend in ("patterns", "hybrid"):
        order = D.PATTERN_ORDER if backend == "patterns" else D.HYBRID_ORDER
        scanned = docs.withColumn("_scan", S.scannable(text))
        if backend == "patterns" or not has_external:
            result = scanned.withColumn("spans", D.hits("_scan", order, resolve=True)).drop("_scan")
            return result.drop("external") if has_external else result
        found = scanned.withColumn("_found", D.hits("_scan", order)).drop("_scan")
        more = X.hybrid_extra(text, given, F.col("_found"), **options)
        found = found.withColumn("_more", more)
        found = found.withColumn("_found", F.concat("_found", "_more")).drop("_more")
    elif not has_external:
        raise ValueError(f"backend {backend!r} needs the model's spans: external=")
    else:
        # Model spans may overlap, which would corrupt the rewritten text.
        chosen = {"spacy": X.ner_spans, "presidio": X.analyzer_spans}.get(backend, X.zero_shot_spans)
        found = docs.withColumn("_found", chosen(text, given, **options))
    result = found.withColumn("spans", S.resolve_overlaps(F.col("_found"))).drop("_found")
    return result.drop("external") if has_external else result


def prepared_spans(
    docs: DataFrame,
    backend: str,
    external: DataFrame | None,
    skip_already_masked: bool,
    **options: Any,
) -> DataFrame:
    """Line joins, detection and the masked-value filter."""
    joined = docs.withColumn("text", join_broken_names(F.col("text")))
    found = detect_spans(joined, backend, external, **options)
    if skip_already_masked:
        found = found.withColumn("spans", S.unmasked(F.col("spans")))
    return found


def is_large(text: Column, size: int = PC.PIECE) -> Column:
    """Whether a text is scanned in pieces; one that is a little longer than a piece is not."""
    return F.coalesce(F.length(text) > 2 * size, F.lit(False))


def spans_in_pieces(
    docs: DataFrame, keys: list[str], backend: str, skip_already_masked: bool, size: int = PC.PIECE
) -> DataFrame:
    """``keys, piece, spans`` of texts whose lines are joined: disjoint, in text order, with
    places in the whole text.  Equal to what ``detect_spans`` finds in the whole."""
    cut = PC.piece_rows(docs, keys, size)
    found = detect_spans(cut, backend).withColumn("spans", PC.own_spans(F.col("spans")))
    if skip_already_masked:
        found = found.withColumn("spans", S.unmasked(F.col("spans")))
    return found.select(*keys, "piece", "spans")


def encode_large(
    docs: DataFrame,
    backend: str = "hybrid",
    skip_already_masked: bool = True,
    piece: int = PC.PIECE,
    **options: Any,
) -> DataFrame:
    """``encode`` for tables that may hold texts of many MB; the same columns and rows.

    Texts above two pieces are scanned by many tasks, a piece a row, and their spans put
    together; numbering and rewriting are one pass over the spans of a text.  Other texts
    go as in ``encode``.  The documents are pinned, since a text meets its spans by row.
    """
    docs = pin_rows(docs)
    large = is_large(F.col("text"), piece)
    options = {"backend": backend, "skip_already_masked": skip_already_masked, **options}
    small = encode(docs.where(~large), **options)
    joined = docs.where(large).withColumn("text", join_broken_names(F.col("text")))
    found = spans_in_pieces(joined, [ROW], backend, skip_already_masked, piece)
    # The compressed size of the texts says nothing about that of their spans: not to be
    # sent through the driver, whatever Spark takes them to be.
    whole = joined.join(PC.gathered(found, [ROW]).hint("merge"), ROW)
    return small.unionByName(encode(whole, **options, spans="spans")).drop(ROW)


def encode(
    docs: DataFrame,
    backend: str = "hybrid",
    strategy: str = "replace",
    external: DataFrame | None = None,
    skip_already_masked: bool = True,
    legend: bool = False,
    strategy_options: dict[str, Any] | None = None,
    known: str | None = None,
    spans: str | None = None,
    **options: Any,
) -> DataFrame:
    """Encode each document on its own: columns ``sanitized`` and ``mapping``.

    ``mapping`` is an array of entries in order of creation.  ``known`` names a column
    with the entries of an earlier mapping, which the document's own extends.  Without
    external spans nothing is shuffled: one scan reads, detects and rewrites.  ``spans``
    names a column of spans that were found before, in texts whose lines are joined.
    """
    apply = strategy_fn(strategy, **(strategy_options or {}))
    if spans is None:
        found = prepared_spans(docs, backend, external, skip_already_masked, **options)
    else:
        found = docs.withColumn("spans", F.col(spans))
    resolved = found.withColumn("_items", E.keyed_spans(F.col("spans"))).withColumn(
        "_entities", E.entities_in_row(F.col("_items"), F.col(known) if known else None)
    )
    if apply is None:
        edits = E.edits_in_row(F.col("_entities"))
    else:
        edits = F.transform(
            F.col("spans"),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                apply(s["value"], s["category"]).alias("replacement"),
            ),
        )
    mapped = (
        resolved.withColumn("mapping", E.mapping_in_row(F.col("_entities")))
        .withColumn("_edits", edits)
        .withColumn("sanitized", splice(F.col("text"), F.col("_edits")))
    )
    if legend:
        mapped = mapped.withColumn(
            "sanitized", F.concat(legend_text_in_row(F.col("mapping")), F.col("sanitized"))
        )
    return mapped.drop("_items", "_entities", "_edits")


def span_rows(docs_with_spans: DataFrame) -> DataFrame:
    """One row per span: ``doc_id, start, end, category, confidence, value, ...``."""
    return explode_structs(docs_with_spans, ["doc_id"], "spans")


def encode_corpus(
    docs: DataFrame,
    backend: str = "hybrid",
    strategy: str = "replace",
    external: DataFrame | None = None,
    mapping: DataFrame | None = None,
    forms: DataFrame | None = None,
    skip_already_masked: bool = True,
    legend: bool = False,
    strategy_options: dict[str, Any] | None = None,
    store: MappingStore | None = None,
    writer: str | None = None,
    batch: int | None = None,
    **options: Any,
) -> Encoded:
    """Encode documents with one shared mapping, new or extended.

    The documents are pinned, so that ids which are null or repeat do no harm.  The
    scan yields spans without text, which are pinned too; all entity work runs on
    them.  The texts move once, by row, to meet their edits.  A ``mapping`` needs the
    surface forms it was built from (``E.stored_forms`` for stored entries).  Texts above
    two pieces are scanned by many tasks.

    With a ``store`` the mapping is the stored one: only the buckets of these documents'
    keys are read, what they add is committed, and the result holds the entries of their
    keys.  ``writer`` and ``batch`` name a batch that may come again.
    """
    apply = strategy_fn(strategy, **(strategy_options or {}))
    if mapping is not None and forms is None:
        raise ValueError("a mapping is extended together with its surface forms: forms=")
    if mapping is not None and store is not None:
        raise ValueError("either a mapping or a store")
    if external is not None:
        docs, external = X.attach_external(docs, external), None
    # Spans of models may cross any cut, so texts that have some are scanned whole.
    in_pieces = "external" not in docs.columns and resolve_backend(backend) in ("patterns", "hybrid")
    docs = pin_rows(docs.withColumn(LARGE, is_large(F.col("text")) & F.lit(in_pieces)))
    keys = ["doc_id", ROW]
    texts = docs.withColumn("text", join_broken_names(F.col("text")))
    # The pinned table is asked for its column of flags alone.
    if docs.where(LARGE).select(LARGE).isEmpty():
        found = prepared_spans(docs, backend, external, skip_already_masked, **options)
        found = found.select(*keys, "spans")
    else:
        small = docs.where(f"NOT {LARGE}")
        found = prepared_spans(small, backend, external, skip_already_masked, **options)
        parts = spans_in_pieces(texts.where(LARGE), keys, backend, skip_already_masked)
        found = found.select(*keys, "spans").unionByName(parts.drop("piece"))
    spans = cut_lineage(
        E.with_key(
            explode_structs(found, keys, "spans").select(
                *keys, "start", "end", "category", "value"
            )
        )
    )
    batch_forms = cut_lineage(E.surface_forms(spans, row=ROW))
    if store is not None:
        full, full_forms = store.extend(batch_forms, writer, batch)
    elif mapping is None:
        full = cut_lineage(E.number_entities(E.entities(batch_forms)))
        full_forms = E.placed_forms(batch_forms, full)
    else:
        full, full_forms = E.extend_mapping(mapping, batch_forms, forms)
        full = cut_lineage(full)
    if apply is None:
        counts = batch_forms.groupBy("norm_key").agg(F.sum("occurrences").alias("n"))
        names = full.where("is_lookup").select("norm_key", "placeholder")
        named = E.lookup(spans, names, "norm_key", counts).select(
            ROW, "start", "end", F.col("placeholder").alias("replacement")
        )
    else:
        named = spans.select(
            ROW,
            "start",
            "end",
            apply(F.col("value"), F.col("category")).alias("replacement"),
        )
    sanitized = apply_edits(texts, named).drop(ROW, LARGE, "external")
    if legend:
        sanitized = sanitized.crossJoin(F.broadcast(legend_text(full))).withColumn(
            "sanitized", F.concat("legend", "sanitized")
        ).drop("legend")
    return Encoded(sanitized, full, full_forms, E.placed_forms(batch_forms, full))


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = ROW) -> DataFrame:
    """Splice ``edits(key, start, end, replacement)`` into the texts.

    ``key`` names a row for sure: a text that misses its edits would leave as it came.
    A group is the edits of one document.
    """
    grouped = edits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits")
    )
    return (
        docs.join(grouped, key, "left")
        .withColumn("sanitized", splice(F.col("text"), F.col("_edits")))
        .drop("_edits")
    )
