"""Registered queries: each inventory item as a Spark job over the given tables
and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import keys as K
from veilframe.functions import spans as S
from veilframe.functions import strategies as ST
from veilframe.functions.arrays import explode_structs, let
from veilframe.functions.text import join_broken_names
from veilframe.operators import decode as DE
from veilframe.operators import detectors as D
from veilframe.operators import dictionary as DI
from veilframe.operators import encode as EN
from veilframe.operators import entities as E
from veilframe.operators import external as X
from veilframe.operators import intervals as IV
from veilframe.operators import pages as P
from veilframe.operators import reports as RE
from veilframe.operators import rules as R
from veilframe.plans import corpus as C
from veilframe.plans import oracle as O
from veilframe.session import cut_lineage, scratch_path
from veilframe.sources import files as SF
from veilframe.sources import jobs as J
from veilframe.sources import mapping_json as MJ
from veilframe.sources import sinks as SK
from veilframe.sources.store import MappingStore
from veilframe.streaming.encode import encode_batches, encode_into_store, encode_stream

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = Query(lambda spark, sf_dir: plain(run(spark, sf_dir)), sql)
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines name the same types."""
    return df.select(
        *[
            F.col(f.name).cast("long").alias(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.ShortType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- shared inputs -----------------------------------------------------------------


def scanned(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Documents as rules see them; with the hits of a list of detectors, if one is given."""
    seen = docs.withColumn("scan", S.scannable(F.col("text")))
    return seen if order is None else seen.withColumn("hits", D.hits("scan", order))


def span_table(docs: DataFrame, spans: Column, order: Sequence[str] | None = None) -> DataFrame:
    """Spans of each document as rows."""
    found = scanned(docs, order).withColumn("spans", spans)
    return explode_structs(found, ["doc_id"], "spans")


def numbered_spans(docs: DataFrame, spans: Column, order: Sequence[str] | None = None) -> DataFrame:
    """Spans of each document as rows, with their place in the list (``ord``)."""
    found = scanned(docs, order).select("doc_id", F.posexplode_outer(spans).alias("ord", "span"))
    return found.where(F.col("span").isNotNull()).select("doc_id", "ord", "span.*")


SPAN_COLS = [
    "doc_id", "`start` AS span_start", "`end` AS span_end", "category", "confidence", "value"
]
SPAN_SQL = (
    "doc_id, s AS span_start, e AS span_end, category, confidence, value"
)
FIRST_PER_PLACE = "QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY pat, seq) = 1"

HYBRID_SQL = O.detect(D.HYBRID_ORDER)
CORPUS_ENCODED = O.encoded(False, D.HYBRID_ORDER)
DOC_ENCODED = O.encoded(True, D.HYBRID_ORDER)
KEPT_ONLY = [O.CORPUS, O.PREPARED, O.folded("prepared")] + HYBRID_SQL + O.resolve(where=O.UNMASKED)


def kept_spans(docs: DataFrame) -> DataFrame:
    """Spans as encode sees them: joined lines, hybrid patterns, masked ones gone."""
    return EN.span_rows(EN.prepared_spans(docs, "hybrid", None, True))


def corpus_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return E.build_mapping(kept_spans(C.corpus(spark, sf_dir)))


def encoded_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return EN.encode(C.corpus(spark, sf_dir), **options)


# --- A: sources and sinks ------------------------------------------------------------


CONV_TEXTS = [
    """texts AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text
      FROM conversations GROUP BY conv_id)"""
]


def conversation_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with a text file for each conversation."""
    out = scratch_path(spark, "texts")
    turns = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("text")
    )
    name = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".txt"))
    SF.write_texts(turns.select(name.alias("output_name"), "text"), out, text="text")
    return out


def file_name(path: str) -> Column:
    return F.regexp_extract(path, r"output_name=([^/]+)/", 1)


@query(
    "a1_text_documents",
    O.sql(
        CONV_TEXTS,
        "SELECT 'conv' || conv_id || '.txt' AS name, length(text) AS n_chars, md5(text) AS text_md5 FROM texts",
    ),
)
def a1(spark, sf_dir):
    docs = SF.read_texts(spark, f"{conversation_files(spark, sf_dir)}/*/*.txt")
    return docs.select(
        file_name("doc_id").alias("name"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def with_file_names(docs: DataFrame) -> DataFrame:
    name = F.concat(F.lit("case."), F.col("doc_id").cast("string"), F.lit(".txt"))
    return SF.with_names(docs, name)


FILE_STEM = "'case.' || cast(doc_id AS VARCHAR)"


def doc_id_of(name: str) -> Column:
    return F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("doc_id")


def files_back(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and text of the files of a sink."""
    return SK.read_files(spark, path).select(
        doc_id_of("name"), F.col("name").alias("output_name"), "n_bytes", F.md5("text").alias("text_md5"),
        F.length("text").alias("n_chars"),
    )


def files_sql(text: str, kind: str, source: str) -> str:
    return (
        f"SELECT doc_id, {FILE_STEM} || '_{kind}.txt' AS output_name, strlen({text}) AS n_bytes, "
        f"md5({text}) AS text_md5, length({text}) AS n_chars FROM {source}"
    )


@query(
    "a2_sanitized_sink",
    O.sql(
        DOC_ENCODED + [O.REPLACED, O.rewritten("prepared", "edits")],
        files_sql("sanitized", "sanitized", "rewritten"),
    ),
)
def a2(spark, sf_dir):
    out = scratch_path(spark, "sanitized")
    named = with_file_names(encoded_rows(spark, sf_dir))
    name = SF.output_name(F.col("stem"), F.col("suffix"), "sanitized")
    SK.write_files(named, out, name, F.col("sanitized"))
    return files_back(spark, out)


@query(
    "a3_mapping_json",
    O.sql(
        DOC_ENCODED
        + [
            """vlist AS (SELECT scope, norm_key, to_json(list_sort(list(DISTINCT value))) AS vj
              FROM keyed GROUP BY ALL)""",
            """stats AS (SELECT scope, string_agg(to_json(category) || ':' || n, ',' ORDER BY f) AS sj
              FROM (SELECT scope, category, count(*) AS n, min(-first_s) AS f FROM ents GROUP BY ALL)
              GROUP BY scope)""",
            """maps AS (SELECT scope, string_agg(to_json(placeholder) || ':{"canonical":' || to_json(canonical)
              || ',"variations":' || vj || ',"occurrences":' || occurrences || '}', ','
              ORDER BY first_s DESC) AS mj FROM ents JOIN vlist USING (scope, norm_key) GROUP BY scope)""",
        ],
        f"""SELECT d.doc_id, {FILE_STEM} || '_mapping.json' AS output_name,
          '{{"version":"1.0","created":"2024-01-01T00:00:00","statistics":{{' || coalesce(sj, '')
          || '}},"mappings":{{' || coalesce(mj, '') || '}}}}' AS json
        FROM docs d LEFT JOIN stats ON d.doc_id = stats.scope LEFT JOIN maps ON d.doc_id = maps.scope""",
    ),
)
def a3(spark, sf_dir):
    """A mapping file for each document, read back."""
    out = scratch_path(spark, "mappings")
    named = with_file_names(encoded_rows(spark, sf_dir))
    json = SF.mapping_json(F.col("mapping"), F.lit("2024-01-01T00:00:00"), pretty=False)
    SK.write_files(named, out, SF.output_name(F.col("stem"), F.col("suffix"), "mapping"), json)
    return SK.read_files(spark, out).select(
        doc_id_of("name"), F.col("name").alias("output_name"), F.col("text").alias("json")
    )


LOADED_SQL = O.sql(
    CORPUS_ENCODED
    + [
        f"""loaded AS (SELECT placeholder, canonical, variations, occurrences, category, num,
          {O.key('canonical', 'category')} AS norm_key FROM ents)"""
    ],
    """SELECT placeholder, canonical, variations, occurrences, category, num, norm_key,
      row_number() OVER (PARTITION BY norm_key ORDER BY category DESC, num DESC) = 1 AS is_lookup FROM loaded""",
)


@query("a4_mapping_split", LOADED_SQL)
def a4_split(spark, sf_dir):
    """The shared mapping's files put end to end, read by many tasks in ranges of bytes."""
    out = scratch_path(spark, "mapping")
    SF.write_mapping(*corpus_mapping(spark, sf_dir), out, "2024-01-01T00:00:00")
    return MJ.read_large_mapping(spark, out, 1 << 16).select(
        "placeholder", "canonical", F.array_join(F.array_sort("variations"), "; ").alias("variations"),
        "occurrences", "category", "num", "norm_key", "is_lookup",
    )


@query("a4_mapping_load", LOADED_SQL)
def a4(spark, sf_dir):
    """The shared mapping, written as the lines of one JSON file and read again."""
    out = scratch_path(spark, "mapping")
    SF.write_mapping(*corpus_mapping(spark, sf_dir), out, "2024-01-01T00:00:00")
    return SF.read_mapping_lines(spark, out).select(
        "placeholder", "canonical", F.array_join("variations", "; ").alias("variations"),
        "occurrences", "category", "num", "norm_key", "is_lookup",
    )


@query(
    "e7_stored_mapping_grows",
    O.sql(
        CORPUS_ENCODED,
        "SELECT placeholder, canonical, variations, occurrences FROM ents",
    ),
)
def e7_stored(spark, sf_dir):
    """The mapping of the documents, written to files, read again, extended by the case
    files, written and read: every form and count is still there."""
    first, second = scratch_path(spark, "mapping"), scratch_path(spark, "mapping")
    SF.write_mapping(*E.build_mapping(kept_spans(C.documents(spark, sf_dir))), first)
    stored = SF.read_mapping_lines(spark, first)
    batch = cut_lineage(E.surface_forms(kept_spans(C.case_files(spark, sf_dir))))
    SF.write_mapping(*E.extend_mapping(stored, batch, E.stored_forms(stored)), second)
    return SF.read_mapping_lines(spark, second).select(
        "placeholder", "canonical", F.array_join("variations", "; ").alias("variations"), "occurrences"
    )


LISTED_RULE = list(R.PLACEHOLDER_RULES)


def decoded_sql(source: str, text: str, per_document: bool) -> list[str]:
    scope = "h.doc_id = x.scope" if per_document else "true"
    return [
        O.folded(source, "folded_s", text),
        O.marked("ph", [R.ANY_PLACEHOLDER_RULE], "folded_s"),
        O.positions("ph", "folded_s"),
        f"""dec_edits AS (SELECT h.doc_id, h.s, h.e, coalesce(nullif(x.canonical, ''), h.v) AS repl
          FROM ph_v h LEFT JOIN ents x ON {scope} AND x.placeholder = h.v)""",
        f"dec_src AS (SELECT doc_id, {text} AS text FROM {source})",
        O.rewritten("dec_src", "dec_edits")
        .replace("pieces", "dec_pieces")
        .replace("rewritten", "dec_rewritten")
        .replace("AS sanitized", "AS decoded"),
    ]


DOC_DECODED = DOC_ENCODED + [O.REPLACED, O.rewritten("prepared", "edits")] + decoded_sql(
    "rewritten", "sanitized", True
)


def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encoded_rows(spark, sf_dir).select(
        "doc_id", F.col("text").alias("original"), "sanitized", "mapping"
    )
    return DE.decode(encoded.withColumn("text", F.col("sanitized")))


@query("a5_decoded_sink", O.sql(DOC_DECODED, files_sql("decoded", "decoded", "dec_rewritten")))
def a5(spark, sf_dir):
    out = scratch_path(spark, "decoded")
    named = with_file_names(decoded_rows(spark, sf_dir))
    SK.write_files(named, out, SF.output_name(F.col("stem"), F.col("suffix"), "decoded"), F.col("decoded"))
    return files_back(spark, out)


CONV_PAGES = """pages_in AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations),
docs AS MATERIALIZED (SELECT doc_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || text,
  chr(10) || chr(10) ORDER BY page_no) AS text FROM pages_in GROUP BY doc_id)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SPLIT_PAGES = f"""page_list AS (SELECT doc_id, list_filter(list_transform(
  regexp_split_to_array(text, '--- Page \\d+ ---'), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS l FROM docs),
page_rows AS (SELECT doc_id, unnest(l) AS text, unnest(generate_series(1, len(l))) AS page_no FROM page_list)"""
PART_ROWS = """part_rows AS (SELECT doc_id, (page_no - 1) // 3 + 1 AS part_no,
  string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM page_rows GROUP BY ALL)"""


def conversation_texts(spark, sf_dir):
    return P.assemble_pages(C.conversation_pages(spark, sf_dir))


@query(
    "a6_part_files",
    O.sql(
        [CONV_PAGES, SPLIT_PAGES, PART_ROWS],
        "SELECT doc_id, 'conv' || doc_id || '_part' || part_no || '.txt' AS output_name, strlen(text) AS n_bytes, "
        "md5(text) AS text_md5, length(text) AS n_chars FROM part_rows",
    ),
)
def a6(spark, sf_dir):
    out = scratch_path(spark, "parts")
    stem = F.concat(F.lit("conv"), F.col("doc_id").cast("string"))
    J.write_parts(conversation_texts(spark, sf_dir).withColumn("doc_id", stem), out, max_pages=3)
    return files_back(spark, out)


@query(
    "a7_binary_info",
    O.sql(
        CONV_TEXTS,
        "SELECT 'conv' || conv_id || '.txt' AS name, strlen(text)::DOUBLE / 1048576 AS size_mb FROM texts",
    ),
)
def a7(spark, sf_dir):
    info = SF.binary_info(spark, f"{conversation_files(spark, sf_dir)}/*/*.txt")
    return info.select(file_name("path").alias("name"), "size_mb")


@query(
    "a8_convert_report",
    O.sql(
        [CONV_PAGES],
        f"""SELECT p.doc_id, count(*) AS total_pages,
          cast(sum(CASE WHEN length({STRIP.format('p.text')}) < 50 THEN 1 ELSE 0 END) AS BIGINT) AS scan_pages,
          count(*) AS native_pages, cast(0 AS BIGINT) AS ocr_pages, max(length(d.text)) AS text_length
        FROM pages_in p JOIN docs d USING (doc_id) GROUP BY p.doc_id""",
    ),
)
def a8(spark, sf_dir):
    return P.convert_report(C.conversation_pages(spark, sf_dir))


# --- B: text preparation -------------------------------------------------------------


@query(
    "b1_line_joins",
    O.sql(
        [O.CORPUS, O.PREPARED],
        "SELECT doc_id, md5(p.text) AS text_md5, length(p.text) = length(d.text) AS same_length, "
        "p.text <> d.text AS changed FROM docs d JOIN prepared p USING (doc_id)",
    ),
)
def b1(spark, sf_dir):
    joined = C.corpus(spark, sf_dir).withColumn("joined", join_broken_names(F.col("text")))
    return joined.select(
        "doc_id",
        F.md5("joined").alias("text_md5"),
        (F.length("joined") == F.length("text")).alias("same_length"),
        (F.col("joined") != F.col("text")).alias("changed"),
    )


@query(
    "b2_assemble_pages",
    O.sql([CONV_PAGES], "SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM docs"),
)
def b2(spark, sf_dir):
    return conversation_texts(spark, sf_dir).select(
        "doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query(
    "b3_split_pages",
    O.sql([CONV_PAGES, SPLIT_PAGES], "SELECT doc_id, page_no, text FROM page_rows"),
)
def b3(spark, sf_dir):
    return P.split_pages(conversation_texts(spark, sf_dir))


@query(
    "b4_page_parts",
    O.sql([CONV_PAGES, SPLIT_PAGES, PART_ROWS], "SELECT doc_id, part_no, text FROM part_rows"),
)
def b4(spark, sf_dir):
    return P.page_parts(conversation_texts(spark, sf_dir), max_pages=3)


@query(
    "b5_character_chunks",
    O.sql(
        [O.CORPUS],
        """SELECT doc_id, i + 1 AS chunk_no, length(c) AS n_chars, md5(c) AS text_md5 FROM (
      SELECT doc_id, i, substring(text, cast(i * 1000 + 1 AS BIGINT), 1000) AS c FROM (
        SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1000)) AS i
        FROM docs WHERE length(text) > 0))""",
    ),
)
def b5(spark, sf_dir):
    return P.character_chunks(C.corpus(spark, sf_dir), 1000).select(
        "doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def _cut_sql(size: int) -> str:
    """End of the chunk that begins after ``pos``."""
    win = f"substring(text, cast(pos + 1 AS BIGINT), {size})"
    para = f"length({win}) - length(list_last(string_split({win}, chr(10) || chr(10)))) - 2"
    sent = f"length({win}) - length(list_last(string_split({win}, '. '))) - 2"
    return (
        f"CASE WHEN pos + {size} >= length(text) THEN length(text) WHEN {para} > {size // 2} "
        f"THEN pos + {para} + 2 WHEN {sent} > {size // 2} THEN pos + {sent} + 2 ELSE pos + {size} END"
    )


WHOLE = O.CORPUS.replace("docs AS", "whole AS")
CHUNK_CUTS = f"""cuts(doc_id, text, chunk_no, chunk_start, pos) AS (
      SELECT doc_id, text, cast(0 AS BIGINT), cast(0 AS BIGINT), cast(0 AS BIGINT) FROM whole
      UNION ALL
      SELECT doc_id, text, chunk_no + 1, pos, {_cut_sql(2000)} FROM cuts WHERE pos < length(text)),
    chunks AS MATERIALIZED (SELECT doc_id, chunk_no, chunk_start, pos AS chunk_end,
      substring(text, cast(chunk_start + 1 AS BIGINT), cast(pos - chunk_start AS BIGINT)) AS text
      FROM cuts WHERE chunk_no > 0)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "b6_paragraph_chunks",
    recursive(
        O.sql([WHOLE, CHUNK_CUTS], "SELECT doc_id, chunk_no, chunk_start, chunk_end, md5(text) AS text_md5 FROM chunks")
    ),
)
def b6(spark, sf_dir):
    return P.paragraph_chunks(C.corpus(spark, sf_dir), 2000).select(
        "doc_id", "chunk_no", "chunk_start", "chunk_end", F.md5("text").alias("text_md5")
    )


@query(
    "b7_scanned_pages",
    f"""SELECT conv_id AS doc_id, turn + 1 AS page_no,
      CASE WHEN length({STRIP.format('text')}) < 50 THEN 'scan' ELSE 'native' END AS kind FROM conversations""",
)
def b7(spark, sf_dir):
    return C.conversation_pages(spark, sf_dir).select(
        "doc_id", "page_no", P.page_kind(F.col("text")).alias("kind")
    )


@query(
    "b8_context_snippets",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(D.PATTERN_ORDER) + O.resolve(),
        """SELECT doc_id, s AS span_start, category, substring(text, cast(greatest(ctx_from, 0) + 1 AS BIGINT),
          cast(ctx_to - greatest(ctx_from, 0) AS BIGINT)) AS context FROM kept JOIN docs USING (doc_id)""",
    ),
)
def b8(spark, sf_dir):
    found = EN.detect_spans(C.corpus(spark, sf_dir), "patterns")
    text = F.col("text")
    snippets = found.select(
        "doc_id",
        F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("span_start"),
                s["category"].alias("category"),
                S.snippet(text, s["ctx_from"], s["ctx_to"]).alias("context"),
            ),
        ).alias("snippets"),
    )
    return explode_structs(snippets, ["doc_id"], "snippets")


# --- C: detectors ----------------------------------------------------------------------


def detector_query(name: str, detector: str) -> None:
    sql = O.sql(
        [O.CORPUS, O.folded()] + O.detector_ctes(detector, 0),
        f"SELECT {SPAN_SQL} FROM d_{detector} {FIRST_PER_PLACE}",
    )

    @query(name, sql)
    def run(spark, sf_dir):
        expr = D.column(getattr(D, detector), "scan")
        return span_table(C.corpus(spark, sf_dir), expr).selectExpr(*SPAN_COLS)


for _name, _detector in (
    ("c1_phones", "phones"),
    ("c2_emails", "emails"),
    ("c3_ibans", "ibans"),
    ("c4_birth_dates", "birth_dates"),
    ("c5_addresses", "addresses"),
    ("c6_national_ids", "national_ids"),
    ("c7_gazetteer_places", "gazetteer_places"),
    ("c8_places", "places"),
    ("c9_context_places", "context_places"),
    ("c10_named_streets", "named_streets"),
    ("c11_any_street", "any_street"),
    ("c12_names", "names"),
    ("c13_names_by_context", "names_by_context"),
    ("c14a_vehicle_brands", "vehicle_brands"),
    ("c14b_vehicles", "vehicles"),
    ("c14c_roads", "roads"),
):
    detector_query(_name, _detector)


def dictionary_sql(detector: str) -> str:
    return O.sql(
        [O.CORPUS, O.folded()] + O.detector_ctes(detector, 0),
        f"SELECT DISTINCT doc_id, s AS span_start, e AS span_end, category, confidence, value FROM d_{detector}",
    )


def dictionary_spans(spark, sf_dir, names, category: str, confidence: float, tail: str = "") -> DataFrame:
    """Spans of a dictionary that is a table."""
    table = spark.createDataFrame([(n,) for n in names], "name string")
    found = DI.find_names(C.corpus(spark, sf_dir), table, tail=tail)
    return found.select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), "value",
    ).distinct()


@query("c7_gazetteer_table", dictionary_sql("gazetteer_places"))
def c7_table(spark, sf_dir):
    return dictionary_spans(spark, sf_dir, R.KNOWN_PLACES, "PLACE", 0.95)


@query("c14a_brand_table", dictionary_sql("vehicle_brands"))
def c14a_table(spark, sf_dir):
    return dictionary_spans(spark, sf_dir, R.VEHICLE_BRANDS, "VEHICLE", 0.92, R.BRAND_TAIL)


@query(
    "c6b_bsn_check",
    f"""SELECT c_custkey, v AS value, ({O.BSN}) % 11 = 0 AS valid FROM (
      SELECT c_custkey, lpad(cast(c_custkey * 7919 + 100000000 AS VARCHAR), 9, '0') AS v FROM customer)""",
)
def c6b(spark, sf_dir):
    value = F.lpad((F.col("c_custkey") * 7919 + 100000000).cast("string"), 9, "0")
    return (
        C.table(spark, sf_dir, "customer")
        .select("c_custkey", value.alias("value"))
        .withColumn("valid", F.expr(D.bsn_check("value")))
    )


@query(
    "c15_detect_all",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(D.PATTERN_ORDER) + O.resolve(),
        f"SELECT {SPAN_SQL} FROM kept",
    ),
)
def c15(spark, sf_dir):
    return EN.span_rows(EN.detect_spans(C.corpus(spark, sf_dir), "patterns")).selectExpr(*SPAN_COLS)


# Stand-in for a model's result: capitalised words and word pairs of the texts,
# labelled and scored by position.
EXTERNAL_RULES = (
    R.Rule(r"\b[A-Z][a-z]{3,}\b"),
    R.Rule(r"\b[A-Z][a-z]+\s[A-Za-z]{2,}\b"),
)
NER_WORDS = "PER|LOC|GPE|ORG|MISC|DATE|FAC|ORGANIZATION|XYZ"
ANALYZER_WORDS = "PERSON|LOCATION|EMAIL_ADDRESS|US_SSN|DATE_TIME|NRP|UNKNOWN|ORGANIZATION|URL"
ZERO_SHOT_WORDS = "person|city|organization|date of birth|tax id|api key|street|password|colour"
LANGS = "nl|en|de|fr"


def _nth(words: str, expr: str) -> str:
    return f"split_part('{words}', '|', cast(({expr}) % {words.count('|') + 1} as int) + 1)"


def external_spans(docs: DataFrame, words: str) -> DataFrame:
    hits = scanned(docs).select("doc_id", F.expr(S.scan("scan", EXTERNAL_RULES)).alias("hits"))
    return explode_structs(hits, ["doc_id"], "hits").select(
        "doc_id",
        "start",
        "end",
        F.expr(_nth(words, "start * 7 + rule")).alias("label"),
        F.expr("((start * 31 + rule * 17) % 100) / 100.0D").alias("score"),
        F.expr(_nth(LANGS, "start + rule")).alias("lang"),
    )


def external_sql(words: str, docs: str = O.CORPUS) -> list[str]:
    return [
        docs,
        O.folded(),
        O.marked("x", EXTERNAL_RULES),
        O.positions("x"),
        f"""ext AS MATERIALIZED (SELECT doc_id, s, e, v, {_nth(words, 's * 7 + pat')} AS label,
          cast(((s * 31 + pat * 17) % 100) AS DOUBLE) / 100.0 AS score, {_nth(LANGS, 's + pat')} AS lang FROM x_v)""",
    ]


def label_case(column: str, labels: dict[str, str], default: str | None) -> str:
    whens = " ".join(f"WHEN {O.quote(k)} THEN {O.quote(v)}" for k, v in labels.items())
    return f"CASE {column} {whens} ELSE {O.quote(default) if default else 'NULL'} END"


EXT_CTX = "s - 20 AS ctx_from, e + 20 AS ctx_to"


def hybrid_sql(docs: str = O.CORPUS, where: str = "true") -> list[str]:
    return external_sql(NER_WORDS, docs) + O.detect(D.HYBRID_ORDER) + [
        f"""plausible AS (SELECT *, {label_case('label', R.HYBRID_LABELS, None)} AS category FROM ext
          WHERE {where} AND category IN ('PERSON', 'PLACE') AND length(trim(v)) >= 2 AND NOT contains(v, '@') AND lower(v) <> 'email'
          AND NOT EXISTS (FROM cands c WHERE c.doc_id = ext.doc_id AND c.s < ext.e AND c.e > ext.s))""",
        """extra AS MATERIALIZED (SELECT doc_id, u.s AS s, u.e AS e, u.v AS v, u.category AS category FROM (
          SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
            CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND k.e > x[1].s)) > 0 THEN acc
                 ELSE list_concat(acc, x) END)) AS u
          FROM (SELECT doc_id, list(struct_pack(s := s, e := e, v := v, category := category)
                ORDER BY s, e, label, score, lang) AS l FROM plausible GROUP BY doc_id)))""",
        f"""all_cands AS (SELECT {O.SPAN} FROM cands UNION ALL
          SELECT doc_id, s, e, category, cast(0.9 AS DOUBLE), v, s - 20, e + 20, 99, 0, s FROM extra)""",
    ]


@query(
    "c16_hybrid",
    O.sql(hybrid_sql() + O.resolve("all_cands"), f"SELECT {SPAN_SQL} FROM kept"),
)
def c16(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    found = EN.detect_spans(docs, "hybrid", external_spans(docs, NER_WORDS))
    return EN.span_rows(found).selectExpr(*SPAN_COLS)


NER_KEPT = f"""ner AS (SELECT *, {label_case('label', R.NER_LABELS, 'MISC')} AS category FROM ext
  WHERE category IN ('PERSON', 'PLACE', 'ORG', 'DATE') AND length(trim(v)) >= 2 AND NOT contains(v, chr(10)))"""


@query(
    "c16_language",
    O.sql(hybrid_sql(where="lang = 'nl'") + O.resolve("all_cands"), f"SELECT {SPAN_SQL} FROM kept"),
)
def c16_language(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    external = external_spans(docs, NER_WORDS)
    found = EN.detect_spans(docs, "hybrid", external, language="Vlaams")
    return EN.span_rows(found).selectExpr(*SPAN_COLS)


CHUNK = 2000
CHUNK_KEY = 100_000  # chunks of a document get ids of their own


@query(
    "b6_chunked_detection",
    recursive(O.sql(
        [
            WHOLE,
            CHUNK_CUTS,
            f"docs AS MATERIALIZED (SELECT doc_id * {CHUNK_KEY} + chunk_no AS doc_id, text FROM chunks)",
            O.folded(),
            O.marked("x", EXTERNAL_RULES),
            O.positions("x"),
            f"""shifted AS (SELECT c.doc_id, x.s + c.chunk_start AS s, x.e + c.chunk_start AS e, v,
              {_nth(NER_WORDS, 'x.s * 7 + pat')} AS label FROM x_v x JOIN chunks c
              ON x.doc_id = c.doc_id * {CHUNK_KEY} + c.chunk_no)""",
            f"""ner AS (SELECT *, {label_case('label', R.NER_LABELS, 'MISC')} AS category FROM shifted
              WHERE category IN ('PERSON', 'PLACE', 'ORG') AND length(trim(v)) >= 2 AND NOT contains(v, chr(10)))""",
            """firsts AS (SELECT * FROM ner
              QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY label) = 1)""",
            """cands AS (SELECT doc_id, s, e, category, cast(0.9 AS DOUBLE) AS confidence, v AS value, s - 20 AS ctx_from,
              e + 20 AS ctx_to, 0 AS det, 0 AS pat, s AS seq FROM firsts)""",
        ]
        + O.resolve(),
        f"SELECT {SPAN_SQL} FROM kept",
    )),
)
def b6_chunked(spark, sf_dir):
    """Model spans are found chunk by chunk, moved to their place in the whole text,
    made one a place and chosen over the whole document."""
    docs = C.corpus(spark, sf_dir)
    chunks = P.paragraph_chunks(docs, CHUNK)
    keyed = chunks.withColumn("doc_id", F.col("doc_id") * CHUNK_KEY + F.col("chunk_no"))
    found = external_spans(keyed, NER_WORDS)
    starts = keyed.select("doc_id", "chunk_start")
    shifted = P.shift_chunk_spans(found.join(starts, "doc_id")).withColumn(
        "doc_id", F.expr(f"doc_id div {CHUNK_KEY}")
    )
    spans = EN.detect_spans(docs, "spacy", shifted.drop("chunk_start"))
    return EN.span_rows(spans).selectExpr(*SPAN_COLS)


@query(
    "c17_ner_spans",
    O.sql(
        external_sql(NER_WORDS) + [NER_KEPT],
        """SELECT doc_id, s AS span_start, e AS span_end, category, cast(0.9 AS DOUBLE) AS confidence, v AS value
        FROM ner QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY label, score, lang) = 1""",
    ),
)
def c17(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, NER_WORDS))
    expr = X.ner_spans(F.col("text"), F.col("external"), include_dates=True)
    return span_table(joined, expr).selectExpr(*SPAN_COLS)


@query(
    "c18_ner_languages",
    O.sql(
        external_sql(NER_WORDS)
        + [
            f"""ner AS (SELECT *, {label_case('label', R.NER_LABELS, 'MISC')} AS category FROM ext
              WHERE category IN ('PERSON', 'PLACE', 'ORG') AND length(trim(v)) >= 2
              AND NOT contains(v, chr(10)) AND lang IN ('de', 'nl', 'en'))"""
        ],
        """SELECT doc_id, s AS span_start, e AS span_end, category, cast(0.9 AS DOUBLE) AS confidence, v AS value
        FROM ner QUALIFY row_number() OVER (PARTITION BY doc_id, s, e
          ORDER BY list_position(['de', 'nl', 'en'], lang), label, score) = 1""",
    ),
)
def c18(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, NER_WORDS))
    expr = X.ner_spans_multi(F.col("text"), F.col("external"), ["de", "nl", "en"])
    return span_table(joined, expr).selectExpr(*SPAN_COLS)


@query(
    "c19_analyzer_spans",
    O.sql(
        external_sql(ANALYZER_WORDS),
        f"""SELECT doc_id, s AS span_start, e AS span_end, {label_case('label', R.ANALYZER_LABELS, 'MISC')} AS category,
          score AS confidence, v AS value FROM ext WHERE score >= 0.5""",
    ),
)
def c19(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, ANALYZER_WORDS))
    expr = X.analyzer_spans(F.col("text"), F.col("external"))
    return span_table(joined, expr).selectExpr(*SPAN_COLS)


@query(
    "c20_zero_shot_spans",
    O.sql(
        external_sql(ZERO_SHOT_WORDS)
        + [
            f"""flat AS (SELECT doc_id, s, e, {label_case('lower(label)', R.ZERO_SHOT_LABELS, 'MISC')} AS category,
              score AS confidence, v AS value, {EXT_CTX}, 0 AS det,
              row_number() OVER (PARTITION BY doc_id ORDER BY s, e, label, score, lang) AS pat, 0 AS seq
              FROM ext WHERE score >= 0.5 AND label IN ({O.quoted(R.ZERO_SHOT_EXTENDED_LABELS)}))"""
        ]
        + O.resolve("flat"),
        f"SELECT {SPAN_SQL} FROM kept",
    ),
)
def c20(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, ZERO_SHOT_WORDS))
    expr = X.zero_shot_spans(F.col("text"), F.col("external"), extended=True)
    return span_table(joined, expr).selectExpr(*SPAN_COLS)


LANGUAGE_WORDS = " Dutch|vlaams|FR|en|Español |klingon|deutsch|it|nederlands"


@query(
    "c21_language_codes",
    f"""SELECT doc_id, given, {label_case("lower(trim(given))", {**{c: c for c in R.LANGUAGES}, **R.LANGUAGE_ALIASES}, None)} AS code
    FROM (SELECT doc_id, lang AS given FROM documents UNION ALL
      SELECT c_custkey + {C.CASE_BASE}, {_nth(LANGUAGE_WORDS, 'c_custkey')} FROM customer)""",
)
def c21(spark, sf_dir):
    """The language of each document, and spellings of languages per case file."""
    given = F.expr(_nth(LANGUAGE_WORDS, "c_custkey"))
    asked = C.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("given")).union(
        C.table(spark, sf_dir, "customer").select(F.col("c_custkey") + C.CASE_BASE, given)
    )
    return asked.withColumn("code", X.language_code(F.col("given")))


@query(
    "c22_backend_auto",
    O.sql(
        [O.CORPUS, O.folded()] + HYBRID_SQL + O.resolve(),
        "SELECT category, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM kept GROUP BY category",
    ),
)
def c22(spark, sf_dir):
    rows = EN.span_rows(EN.detect_spans(C.corpus(spark, sf_dir), "auto"))
    per_doc = rows.groupBy("category", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("category").agg(
        F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_docs")
    )


# --- D: span algebra ---------------------------------------------------------------------


@query(
    "d1_exact_dedup",
    O.sql(
        [O.CORPUS, O.folded()] + O.detector_ctes("phones", 0),
        """SELECT doc_id, count(*) AS candidates, count(DISTINCT (s, e)) AS places FROM d_phones GROUP BY doc_id""",
    ),
)
def d1(spark, sf_dir):
    found = scanned(C.corpus(spark, sf_dir)).withColumn("all", F.expr(D.phones("scan")))
    counted = found.select(
        "doc_id",
        let(
            F.col("all"),
            lambda a: F.when(
                F.size(a) > 0,
                F.array(
                    F.struct(
                        F.size(a).alias("candidates"),
                        F.size(S.first_per_place(a)).alias("places"),
                    )
                ),
            ),
        ).alias("counts"),
    )
    return explode_structs(counted, ["doc_id"], "counts")


OVERLAPPING = ("phones", "ibans", "national_ids", "addresses")


@query(
    "d2_resolve_overlaps",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(OVERLAPPING) + O.resolve(), f"SELECT {SPAN_SQL} FROM kept"
    ),
)
def d2(spark, sf_dir):
    expr = S.resolve_overlaps(D.detect("scan", OVERLAPPING, "hits"))
    return span_table(C.corpus(spark, sf_dir), expr, OVERLAPPING).selectExpr(*SPAN_COLS)


@query(
    "d2_resolve_rows",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(OVERLAPPING) + O.resolve(), f"SELECT {SPAN_SQL} FROM kept"
    ),
)
def d2_rows(spark, sf_dir):
    """The same from a table of spans: islands over rows, a choice in each."""
    rows = numbered_spans(C.corpus(spark, sf_dir), D.detect("scan", OVERLAPPING, "hits"), OVERLAPPING)
    rank = [-F.col("confidence"), F.col("start") - F.col("end"), F.col("ord")]
    return IV.resolve_rows(rows, "doc_id", rank).selectExpr(*SPAN_COLS)


MODELS_SQL = O.sql(
    [O.CORPUS, O.folded()] + O.detector_ctes("vehicles", 0),
    f"SELECT {SPAN_SQL} FROM d_vehicles WHERE pat >= 1000",
)


@query("d3_models_beside_brand_rows", MODELS_SQL)
def d3_rows(spark, sf_dir):
    """The same as a join of span tables over bins."""
    docs = C.corpus(spark, sf_dir)
    models = numbered_spans(docs, F.expr(D.vehicle_models("scan")))
    brands = numbered_spans(docs, F.expr(D.vehicle_brands("scan")))
    return IV.free_rows(models, brands, "doc_id", [F.col("ord")]).selectExpr(*SPAN_COLS)


@query("d3_models_beside_brands", MODELS_SQL)
def d3(spark, sf_dir):
    expr = S.keep_free(F.expr(D.vehicle_models("scan")), F.expr(D.vehicle_brands("scan")))
    return span_table(C.corpus(spark, sf_dir), expr).selectExpr(*SPAN_COLS)


BESIDE_SQL = O.sql(
    hybrid_sql(), "SELECT doc_id, s AS span_start, e AS span_end, category, v AS value FROM extra"
)


@query("d4_entities_beside_pattern_rows", BESIDE_SQL)
def d4_rows(spark, sf_dir):
    """The same as a join of span tables over bins."""
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, NER_WORDS))
    entities = numbered_spans(joined, X.plausible_entities(F.col("text"), F.col("external")))
    patterns = numbered_spans(docs, D.detect("scan", D.HYBRID_ORDER, "hits"), D.HYBRID_ORDER)
    return IV.free_rows(entities, patterns, "doc_id", [F.col("ord")]).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", "value"
    )


@query("d4_entities_beside_patterns", BESIDE_SQL)
def d4(spark, sf_dir):
    docs = C.corpus(spark, sf_dir)
    joined = X.attach_external(docs, external_spans(docs, NER_WORDS))
    expr = X.hybrid_extra(F.col("text"), F.col("external"), D.detect("scan", D.HYBRID_ORDER, "hits"))
    return span_table(joined, expr, D.HYBRID_ORDER).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", "value"
    )


@query(
    "d5_union_of_detectors",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(D.PATTERN_ORDER),
        "SELECT category, confidence, count(DISTINCT (doc_id, s, e)) AS places FROM cands GROUP BY ALL",
    ),
)
def d5(spark, sf_dir):
    rows = span_table(C.corpus(spark, sf_dir), D.detect("scan", D.PATTERN_ORDER, "hits"), D.PATTERN_ORDER)
    places = rows.groupBy("category", "confidence", "doc_id", "start", "end").agg(
        F.count(F.lit(1)).alias("n")
    )
    return places.groupBy("category", "confidence").agg(F.count(F.lit(1)).alias("places"))


@query(
    "d6_masked_filter",
    O.sql(
        [O.CORPUS, O.folded()] + HYBRID_SQL + O.resolve(),
        """SELECT doc_id, s AS span_start, value, contains(value, 'XX') OR contains(value, 'xx')
          OR contains(value, '***') AS masked FROM kept""",
    ),
)
def d6(spark, sf_dir):
    return EN.span_rows(EN.detect_spans(C.corpus(spark, sf_dir), "hybrid")).select(
        "doc_id", F.col("start").alias("span_start"), "value", S.is_masked(F.col("value")).alias("masked")
    )


@query(
    "d7_span_order",
    O.sql(
        KEPT_ONLY,
        """SELECT doc_id, s AS span_start, value, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS nth_from_start,
          row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS nth_from_end FROM kept""",
    ),
)
def d7(spark, sf_dir):
    found = EN.prepared_spans(C.corpus(spark, sf_dir), "hybrid", None, True)
    placed = found.select(
        "doc_id",
        let(
            F.col("spans"),
            lambda all_spans: F.transform(
                all_spans,
                lambda s, i: F.struct(
                    s["start"].alias("span_start"),
                    s["value"].alias("value"),
                    (i + 1).alias("nth_from_start"),
                    (F.size(all_spans) - i).alias("nth_from_end"),
                ),
            ),
        ).alias("placed"),
    )
    return explode_structs(placed, ["doc_id"], "placed")


@query(
    "d8_category_filter",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(D.PATTERN_ORDER) + O.resolve(),
        f"SELECT {SPAN_SQL} FROM kept WHERE category IN ('PERSON', 'PLACE') AND confidence >= 0.85",
    ),
)
def d8(spark, sf_dir):
    found = EN.detect_spans(C.corpus(spark, sf_dir), "patterns").withColumn(
        "spans", S.in_categories(F.col("spans"), ["PERSON", "PLACE"], 0.85)
    )
    return EN.span_rows(found).selectExpr(*SPAN_COLS)


# --- E: entity resolution ------------------------------------------------------------------


@query(
    "e1_entity_keys",
    O.sql(
        KEPT_ONLY,
        f"SELECT doc_id, s AS span_start, category, value, {O.key()} AS norm_key FROM kept",
    ),
)
def e1(spark, sf_dir):
    return E.with_key(kept_spans(C.corpus(spark, sf_dir))).select(
        "doc_id", F.col("start").alias("span_start"), "category", "value", "norm_key"
    )


def key_query(name: str, category: str, key: Callable[[Column], Column]) -> None:
    sql = O.sql(
        KEPT_ONLY,
        f"SELECT {O.key()} AS norm_key, count(*) AS n, count(DISTINCT value) AS n_forms "
        f"FROM kept WHERE category = '{category}' GROUP BY 1",
    )

    @query(name, sql)
    def run(spark, sf_dir):
        forms = (
            kept_spans(C.corpus(spark, sf_dir))
            .where(F.col("category") == category)
            .groupBy("value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return (
            forms.groupBy(key(F.col("value")).alias("norm_key"))
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms"))
        )


key_query("e2_name_keys", "PERSON", K.name_key)
key_query("e3_phone_keys", "PHONE", K.phone_key)
key_query("e4_iban_keys", "IBAN", K.iban_key)


@query(
    "e5_entities",
    O.sql(
        CORPUS_ENCODED,
        "SELECT norm_key, category, canonical, occurrences, n_variations, first_doc FROM ents",
    ),
)
def e5(spark, sf_dir):
    return E.entities(E.surface_forms(kept_spans(C.corpus(spark, sf_dir)))).select(
        "norm_key", "category", "canonical", "occurrences", "n_variations", "first_doc"
    )


@query(
    "e6_numbering",
    O.sql(CORPUS_ENCODED, "SELECT norm_key, category, num, placeholder, canonical FROM ents"),
)
def e6(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    return mapping.select("norm_key", "category", "num", "placeholder", "canonical")


@query(
    "e7_growing_mapping",
    O.sql(
        CORPUS_ENCODED,
        "SELECT norm_key, category, num, placeholder, canonical, occurrences, n_variations FROM ents",
    ),
)
def e7(spark, sf_dir):
    """The documents first, then the case files on top of their mapping."""
    first, forms = E.build_mapping(kept_spans(C.documents(spark, sf_dir)))
    batch = cut_lineage(E.surface_forms(kept_spans(C.case_files(spark, sf_dir))))
    grown, _ = E.extend_mapping(first, batch, forms)
    return grown.select(
        "norm_key", "category", "num", "placeholder", "canonical", "occurrences", "n_variations"
    )


@query(
    "e7_mapping_store",
    O.sql(
        CORPUS_ENCODED,
        """SELECT e.norm_key, category, num, placeholder, canonical, occurrences, n_variations, n_forms
        FROM ents e JOIN (SELECT norm_key, count(DISTINCT value) AS n_forms FROM keyed GROUP BY ALL) USING (norm_key)""",
    ),
)
def e7_store(spark, sf_dir):
    """The documents, then the case files, by a store that each batch reads in part; the
    case files come twice, the second time without effect."""
    store = MappingStore(spark, scratch_path(spark, "store"), n_buckets=16)
    for i, docs in enumerate((C.documents(spark, sf_dir), C.case_files(spark, sf_dir))):
        batch = cut_lineage(E.surface_forms(kept_spans(docs)))
        for _ in range(i + 1):
            store.extend(batch, "corpus", i)
    forms = store.forms().groupBy("placeholder").agg(F.count(F.lit(1)).alias("n_forms"))
    return store.mapping().join(forms, "placeholder").select(
        "norm_key", "category", "num", "placeholder", "canonical", "occurrences", "n_variations",
        "n_forms",
    )


@query(
    "e8_get_original",
    O.sql(
        CORPUS_ENCODED
        + ["asked AS (SELECT c_custkey, 'PERSON_' || lpad(cast(c_custkey AS VARCHAR), 3, '0') AS placeholder FROM customer WHERE c_custkey < 1000 UNION ALL SELECT c_custkey, 'PERSON_' || cast(c_custkey AS VARCHAR) FROM customer WHERE c_custkey >= 1000)"],
        "SELECT c_custkey, a.placeholder, canonical FROM asked a LEFT JOIN ents USING (placeholder)",
    ),
)
def e8(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    asked = C.table(spark, sf_dir, "customer").select(
        "c_custkey", K.placeholder(F.lit("PERSON"), F.col("c_custkey")).alias("placeholder")
    )
    return DE.get_original(mapping, asked).select("c_custkey", "placeholder", "canonical")


# --- F: strategies ----------------------------------------------------------------------------


@query(
    "f1_replace",
    O.sql(
        CORPUS_ENCODED + [O.REPLACED],
        "SELECT doc_id, s AS span_start, e AS span_end, repl AS replacement FROM edits",
    ),
)
def f1(spark, sf_dir):
    spans = cut_lineage(
        E.with_key(kept_spans(C.corpus(spark, sf_dir))).select("doc_id", "start", "end", "category", "value", "norm_key")
    )
    mapping, _ = E.build_mapping(spans)
    named = E.lookup(spans, mapping.select("norm_key", "placeholder"), "norm_key")
    return named.select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.col("placeholder").alias("replacement"),
    )


def stars(n: str) -> str:
    return f"repeat('*', cast(greatest({n}, 0) AS BIGINT))"


def mask_words_sql(v: str = "value") -> str:
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: CASE WHEN length(w) <= 3 THEN {stars('length(w)')} ELSE substring(w, 1, 1) || "
        f"{stars('length(w) - 3')} || right(w, 2) END), ' ')"
    )


MASK_EMAIL = (
    "regexp_replace(value, '^([\\s\\S]*)@[^@]*$', '\\1')[1] || "
    + stars("length(regexp_replace(value, '^([\\s\\S]*)@[^@]*$', '\\1')) - 1")
    + " || '@' || regexp_extract(value, '@([^@]*)\\.[^.@]*$', 1)[1] || "
    + stars("length(regexp_extract(value, '@([^@]*)\\.[^.@]*$', 1)) - 1")
    + " || '.' || regexp_extract(value, '([^.@]*)$', 1)"
)
MASK_PHONE = f"""CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) <= 4 THEN {stars('length(value)')}
  ELSE array_to_string(list_transform(generate_series(1, length(value)), lambda i:
    CASE WHEN regexp_matches(value[i], '[0-9]')
      AND length(regexp_replace(value[1:i], '[^0-9]', '', 'g')) > 2
      AND length(regexp_replace(value[1:i], '[^0-9]', '', 'g')) <= length(regexp_replace(value, '[^0-9]', '', 'g')) - 2
    THEN '*' ELSE value[i] END), '') END"""
IBAN_CLEAN = "replace(value, ' ', '')"
IBAN_MASKED = f"{IBAN_CLEAN}[1:4] || {stars(f'length({IBAN_CLEAN}) - 8')} || right({IBAN_CLEAN}, 4)"
MASK_IBAN = f"""CASE WHEN length({IBAN_CLEAN}) < 8 THEN {stars('length(value)')}
  WHEN contains(value, ' ') THEN rtrim(regexp_replace({IBAN_MASKED}, '(.{{4}})', '\\1 ', 'g'))
  ELSE {IBAN_MASKED} END"""


def strategy_query(name: str, sql_value: str, fn: Callable[[], ST.StrategyFn], category: str | None = None) -> None:
    where = f"WHERE category = '{category}'" if category else ""
    sql = O.sql(
        KEPT_ONLY,
        f"SELECT doc_id, s AS span_start, category, {sql_value} AS anonymized FROM kept {where}",
    )

    @query(name, sql)
    def run(spark, sf_dir):
        rows = kept_spans(C.corpus(spark, sf_dir))
        if category:
            rows = rows.where(F.col("category") == category)
        return rows.select(
            "doc_id", F.col("start").alias("span_start"), "category",
            fn()(F.col("value"), F.col("category")).alias("anonymized"),
        )


strategy_query("f2_redact", "'[' || category || ']'", lambda: ST.strategy_fn("redact"))
strategy_query(
    "f3_mask_words", mask_words_sql(), lambda: (lambda v, c: ST.mask_words(v)), "PERSON"
)
strategy_query("f4_mask_email", MASK_EMAIL, lambda: ST.strategy_fn("mask"), "EMAIL")
strategy_query("f5_mask_phone", MASK_PHONE, lambda: ST.strategy_fn("mask"), "PHONE")
strategy_query("f6_mask_iban", MASK_IBAN, lambda: ST.strategy_fn("mask"), "IBAN")
strategy_query(
    "f7_hash",
    "substring(sha256('pepper' || value || category), 1, 16)",
    lambda: ST.strategy_fn("hash", salt="pepper"),
)


@query(
    "f8_encrypt_round_trip",
    O.sql(
        KEPT_ONLY,
        "SELECT doc_id, s AS span_start, value AS decrypted, true AS changed FROM kept",
    ),
)
def f8(spark, sf_dir):
    key = b"0123456789abcdef"
    rows = kept_spans(C.corpus(spark, sf_dir))
    token = ST.strategy_fn("encrypt", key=key)(F.col("value"), F.col("category"))
    sealed = rows.withColumn("token", token)
    return sealed.select(
        "doc_id", F.col("start").alias("span_start"),
        ST.decrypt(F.col("token"), key).alias("decrypted"),
        (F.col("token") != F.col("value")).alias("changed"),
    )


def encoded_md5(strategy: str, **options) -> Run:
    def run(spark, sf_dir):
        return EN.encode(
            C.corpus(spark, sf_dir), strategy=strategy, strategy_options=options
        ).select("doc_id", F.md5("sanitized").alias("text_md5"), F.size("mapping").alias("entries"))

    return run


def encoded_md5_sql(replacement: str) -> str:
    return O.sql(
        O.encoded(True, D.HYBRID_ORDER)
        + [
            f"edits AS (SELECT doc_id, s, e, {replacement} AS repl FROM keyed)",
            O.rewritten("prepared", "edits"),
        ],
        "SELECT r.doc_id, md5(sanitized) AS text_md5, (SELECT count(*) FROM ents x WHERE x.scope = r.doc_id) AS entries FROM rewritten r",
    )


MASK_ANY = (
    f"CASE category WHEN 'EMAIL' THEN {MASK_EMAIL} WHEN 'PHONE' THEN {MASK_PHONE} "
    f"WHEN 'IBAN' THEN {MASK_IBAN} ELSE {mask_words_sql()} END"
)
query("f9_strategy_mask", encoded_md5_sql(MASK_ANY))(encoded_md5("mask"))


@query(
    "f10_reversible_strategies",
    O.sql(
        KEPT_ONLY + ["st(strategy, reversible) AS (VALUES ('replace', true), ('redact', false), ('mask', false), ('hash', false), ('encrypt', true))"],
        "SELECT strategy, reversible, count(*) AS n_spans FROM kept CROSS JOIN st GROUP BY ALL",
    ),
)
def f10(spark, sf_dir):
    n = kept_spans(C.corpus(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_spans"))
    flags = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), F.lit(ST.can_deanonymize(s)).alias("reversible"))
            for s in ("replace", "redact", "mask", "hash", "encrypt")
        ]
    )
    return n.select("n_spans", F.inline(flags)).select("strategy", "reversible", "n_spans")


# --- G: rewrite -----------------------------------------------------------------------------


@query("g1_splice", encoded_md5_sql("'[' || category || ']'"))
def g1(spark, sf_dir):
    return encoded_md5("redact")(spark, sf_dir)


@query(
    "g2_encode_documents",
    O.sql(
        O.encoded(True, D.PATTERN_ORDER) + [O.REPLACED, O.rewritten("prepared", "edits")],
        "SELECT doc_id, sanitized FROM rewritten",
    ),
)
def g2(spark, sf_dir):
    return EN.encode(C.corpus(spark, sf_dir), backend="patterns").select("doc_id", "sanitized")


@query(
    "g2_encode_corpus",
    O.sql(
        CORPUS_ENCODED + [O.REPLACED, O.rewritten("prepared", "edits")],
        "SELECT doc_id, sanitized FROM rewritten",
    ),
)
def g2_corpus(spark, sf_dir):
    return EN.encode_corpus(C.corpus(spark, sf_dir)).documents.select("doc_id", "sanitized")


def legend_sql(counts: str) -> str:
    """Legend text from ``counts(category, n)`` of one scope."""
    head = " || chr(10) || ".join(O.quote(x) for x in R.LEGEND_HEAD)
    tail = " || chr(10) || ".join(O.quote(x) for x in R.LEGEND_TAIL)
    desc = label_case("category", R.CATEGORY_DESCRIPTIONS, "Other")
    lines = f"string_agg('  ' || category || '_NNN : ' || {desc} || ' (' || n || ' unique)', chr(10) ORDER BY category)"
    return f"{head} || chr(10) || coalesce({lines} || chr(10), '') || {tail}"


@query(
    "g3_legend",
    O.sql(
        CORPUS_ENCODED + ["counts AS (SELECT category, count(*) AS n FROM ents GROUP BY category)"],
        f"SELECT {legend_sql('counts')} AS legend FROM counts",
    ),
)
def g3(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    return RE.legend_text(mapping)


LEGENDS = [
    "counts AS (SELECT scope, category, count(*) AS n FROM ents GROUP BY ALL)",
    f"legends AS (SELECT scope, {legend_sql('counts')} AS legend FROM counts GROUP BY scope)",
    f"no_legend AS (SELECT {legend_sql('counts')} AS legend FROM counts WHERE false)",
]


@query(
    "g4_encode_with_legend",
    O.sql(
        DOC_ENCODED + [O.REPLACED, O.rewritten("prepared", "edits")] + LEGENDS,
        "SELECT r.doc_id, coalesce(l.legend, (SELECT legend FROM no_legend)) || sanitized AS sanitized FROM rewritten r LEFT JOIN legends l ON r.doc_id = l.scope",
    ),
)
def g4(spark, sf_dir):
    return encoded_rows(spark, sf_dir, legend=True).select("doc_id", "sanitized")


def corpus_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with a text file for each document and case file."""
    out = scratch_path(spark, "files")
    named = with_file_names(C.corpus(spark, sf_dir))
    SK.write_files(named, out, F.concat("stem", "suffix"), F.col("text"))
    return out


@query(
    "g5_encode_files",
    O.sql(
        O.encoded(True, D.PATTERN_ORDER) + [O.REPLACED, O.rewritten("prepared", "edits")],
        files_sql("sanitized", "sanitized", "rewritten")
        + f" UNION ALL SELECT doc_id, {FILE_STEM} || '_mapping.json', (SELECT count(*) FROM ents x WHERE x.scope = r.doc_id),"
        " NULL, NULL FROM rewritten r",
    ),
)
def g5(spark, sf_dir):
    """Files in, files out, read back: of a mapping file its number of entries."""
    out = scratch_path(spark, "encoded")
    J.encode_files(spark, corpus_files(spark, sf_dir), out, backend="patterns")
    is_mapping = F.col("output_name").endswith("_mapping.json")
    entries = F.size(F.map_keys(F.from_json("text", SF.MAPPING_SCHEMA)["mappings"]))
    back = SK.read_files(spark, out).withColumnRenamed("name", "output_name")
    return back.select(
        doc_id_of("output_name"), "output_name",
        F.when(is_mapping, entries).otherwise(F.col("n_bytes")).alias("n_bytes"),
        F.when(~is_mapping, F.md5("text")).alias("text_md5"),
        F.when(~is_mapping, F.length("text")).alias("n_chars"),
    )


LARGE_DOCS = f"""docs AS MATERIALIZED (
  SELECT c_custkey % 12 AS doc_id, string_agg({C.CASE_TEXT}, chr(10) ORDER BY c_custkey) AS text
  FROM customer GROUP BY 1)"""


def large_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All case files as twelve large texts."""
    files = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    number = ((F.col("doc_id") - C.CASE_BASE) % 12).alias("number")
    return C.case_files(spark, sf_dir).groupBy(number).agg(F.array_join(files["text"], "\n").alias("text")).select(
        F.col("number").alias("doc_id"), "text"
    )


@query(
    "g2_encode_large",
    O.sql(
        O.encoded(True, D.HYBRID_ORDER, LARGE_DOCS) + [O.REPLACED, O.rewritten("prepared", "edits")],
        "SELECT doc_id, length(docs.text) AS n_chars, sanitized FROM rewritten JOIN docs USING (doc_id)",
    ),
)
def g2_large(spark, sf_dir):
    """Texts above two pieces are scanned by many tasks."""
    texts = large_texts(spark, sf_dir).withColumn("n_chars", F.length("text"))
    return EN.encode_large(texts).select("doc_id", "n_chars", "sanitized")


@query(
    "g6_convert_and_sanitize",
    O.sql(
        O.encoded(True, D.HYBRID_ORDER, CONV_PAGES)
        + [O.REPLACED, O.rewritten("prepared", "edits")]
        + LEGENDS,
        "SELECT r.doc_id, coalesce(l.legend, (SELECT legend FROM no_legend)) || sanitized AS sanitized FROM rewritten r LEFT JOIN legends l ON r.doc_id = l.scope",
    ),
)
def g6(spark, sf_dir):
    return EN.encode(conversation_texts(spark, sf_dir), legend=True).select("doc_id", "sanitized")


PARTS_AS_DOCS = "docs AS MATERIALIZED (SELECT doc_id * 1000 + part_no AS doc_id, text FROM part_rows)"


@query(
    "g6_parts",
    O.sql(
        O.encoded(
            True,
            D.HYBRID_ORDER,
            ",\n".join([CONV_PAGES.replace("docs AS", "whole AS"), SPLIT_PAGES.replace("FROM docs", "FROM whole"), PART_ROWS, PARTS_AS_DOCS]),
        )
        + [O.REPLACED, O.rewritten("prepared", "edits")]
        + LEGENDS,
        """SELECT r.doc_id // 1000 AS doc_id, r.doc_id % 1000 AS part_no,
          coalesce(l.legend, (SELECT legend FROM no_legend)) || sanitized AS sanitized
        FROM rewritten r LEFT JOIN legends l ON r.doc_id = l.scope""",
    ),
)
def g6_parts(spark, sf_dir):
    """Each part with a mapping of its own."""
    parts = P.page_parts(conversation_texts(spark, sf_dir), max_pages=3)
    return EN.encode(parts, legend=True).select("doc_id", "part_no", "sanitized")


# --- H: decode ------------------------------------------------------------------------------


@query("h1_decode_documents", O.sql(DOC_DECODED, "SELECT doc_id, decoded FROM dec_rewritten"))
def h1(spark, sf_dir):
    return decoded_rows(spark, sf_dir).select("doc_id", "decoded")


@query(
    "h1_decode_corpus",
    O.sql(
        CORPUS_ENCODED
        + [O.REPLACED, O.rewritten("prepared", "edits")]
        + decoded_sql("rewritten", "sanitized", False),
        "SELECT doc_id, decoded FROM dec_rewritten",
    ),
)
def h1_corpus(spark, sf_dir):
    encoded = EN.encode_corpus(C.corpus(spark, sf_dir))
    returned = encoded.documents.select("doc_id", F.col("sanitized").alias("text"))
    return DE.decode_corpus(returned, encoded.mapping).select("doc_id", "decoded")


FOUND_PLACEHOLDERS = [O.CORPUS, O.folded(), O.marked("ph", LISTED_RULE), O.positions("ph")]


@query(
    "h2_placeholder_spans",
    O.sql(FOUND_PLACEHOLDERS, "SELECT doc_id, s AS span_start, e AS span_end, v AS placeholder FROM ph_v"),
)
def h2(spark, sf_dir):
    return DE.find_placeholders(C.corpus(spark, sf_dir)).select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "placeholder"
    )


@query("h3_decode_files", O.sql(DOC_DECODED, files_sql("decoded", "decoded", "dec_rewritten")))
def h3(spark, sf_dir):
    """Decode from files: sanitised texts and mapping JSON are read, decoded files written
    and read back."""
    stored, out = scratch_path(spark, "encoded"), scratch_path(spark, "decoded")
    J.encode_files(spark, corpus_files(spark, sf_dir), stored)
    J.decode_files(spark, f"{stored}/*_sanitized.txt", f"{stored}/*_mapping.json", out)
    return files_back(spark, out)


@query(
    "h4_find_placeholders",
    O.sql(
        FOUND_PLACEHOLDERS,
        "SELECT regexp_extract(v, '^(.*)_', 1) AS category, regexp_extract(v, '_([0-9]+)$', 1) AS number, count(*) AS n FROM ph_v GROUP BY ALL",
    ),
)
def h4(spark, sf_dir):
    return DE.find_placeholders(C.corpus(spark, sf_dir)).groupBy("category", "number").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "h5_validate_decode",
    O.sql(
        DOC_DECODED
        + [
            """checked AS (SELECT d.doc_id, p.text AS original, r.sanitized, d.decoded,
              list_min(list_filter(generate_series(1, least(length(p.text), length(d.decoded))),
                lambda i: p.text[i] <> d.decoded[i])) - 1 AS place
              FROM dec_rewritten d JOIN rewritten r USING (doc_id) JOIN prepared p USING (doc_id))"""
        ],
        """SELECT doc_id, length(original) AS original_length, length(sanitized) AS sanitized_length,
          length(decoded) AS decoded_length, length(original) = length(decoded) AS lengths_match,
          original = decoded AS content_match, place AS first_diff_position,
          CASE WHEN place IS NOT NULL THEN original[greatest(place - 20, 0) + 1 : place + 20] END AS first_diff_original,
          CASE WHEN place IS NOT NULL THEN decoded[greatest(place - 20, 0) + 1 : place + 20] END AS first_diff_decoded
        FROM checked""",
    ),
)
def h5(spark, sf_dir):
    return DE.validate_decode(decoded_rows(spark, sf_dir)).select(
        "doc_id", "original_length", "sanitized_length", "decoded_length", "lengths_match",
        "content_match", "first_diff_position", "first_diff_original", "first_diff_decoded",
    )


# --- I: reports -----------------------------------------------------------------------------

STATISTICS_SQL = """SELECT category, unique_values, occurrences, examples FROM (
  SELECT category, count(*) AS unique_values, cast(sum(occurrences) AS BIGINT) AS occurrences,
    string_agg(CASE WHEN num <= 3 THEN placeholder || ' → ' || CASE WHEN length(canonical) > 30
      THEN substring(canonical, 1, 30) || '...' ELSE canonical END END, '; ' ORDER BY num) AS examples
  FROM ents GROUP BY category
  UNION ALL SELECT NULL, count(*), cast(sum(occurrences) AS BIGINT), NULL FROM ents)"""


@query("i1_statistics", O.sql(CORPUS_ENCODED, STATISTICS_SQL))
def i1(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    return RE.statistics(mapping).select("category", "unique_values", "occurrences", "examples")


@query(
    "i2_analyze",
    O.sql(
        [O.CORPUS, O.folded()] + O.detect(D.PATTERN_ORDER) + O.resolve(),
        """SELECT doc_id, category, any_value(length(text)) AS characters, any_value(total) AS total,
          count(*) AS found, string_agg(CASE WHEN nth <= 5 THEN value END, '; ' ORDER BY s) AS examples
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total,
                row_number() OVER (PARTITION BY doc_id, category ORDER BY s) AS nth FROM kept)
        JOIN docs USING (doc_id) GROUP BY doc_id, category""",
    ),
)
def i2(spark, sf_dir):
    return RE.analyze(EN.detect_spans(C.corpus(spark, sf_dir), "patterns")).select(
        "doc_id", "category", "characters", "total", "found", "examples"
    )


@query(
    "i3_dry_run",
    O.sql(
        CORPUS_ENCODED,
        "SELECT placeholder, canonical FROM ents UNION ALL SELECT 'TOTAL', cast(count(*) AS VARCHAR) FROM ents",
    ),
)
def i3(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    return RE.dry_run(mapping)


@query(
    "i4_show_mapping",
    O.sql(
        CORPUS_ENCODED,
        "SELECT placeholder, canonical, CASE WHEN n_variations > 1 THEN variations END AS variations, occurrences, "
        "row_number() OVER (ORDER BY placeholder) AS entry_no FROM ents",
    ),
)
def i4(spark, sf_dir):
    mapping, forms = corpus_mapping(spark, sf_dir)
    return RE.show_mapping(mapping, forms)


@query(
    "i5_counters",
    O.sql(
        CORPUS_ENCODED,
        "SELECT category, max(num) AS counter, cast(sum(max(num)) OVER () AS BIGINT) AS total FROM ents GROUP BY category",
    ),
)
def i5(spark, sf_dir):
    mapping, _ = corpus_mapping(spark, sf_dir)
    per_category = RE.counters(mapping)
    total = per_category.agg(F.sum("counter").alias("total"))
    return per_category.crossJoin(F.broadcast(total))


@query(
    "i6_label_usage",
    O.sql(
        external_sql(NER_WORDS),
        f"""SELECT label, {label_case('label', R.NER_LABELS, None)} AS category, count(*) AS n FROM ext GROUP BY ALL""",
    ),
)
def i6(spark, sf_dir):
    """Labels found in the texts against the table of supported labels."""
    supported = RE.label_tables(spark).where("backend = 'spacy'").select("label", "category")
    used = external_spans(C.corpus(spark, sf_dir), NER_WORDS).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )
    return used.join(F.broadcast(supported), "label", "left").select("label", "category", "n")


# --- K: extensions ------------------------------------------------------------------------------


def initials(mark: str = ".") -> ST.StrategyFn:
    return lambda value, category: F.concat(F.substring(value, 1, 1), F.lit(mark))


@query("k1_custom_strategy", encoded_md5_sql("value[1] || '.'"))
def k1(spark, sf_dir):
    ST.register_strategy("initials", initials)
    return encoded_md5("initials")(spark, sf_dir)


def load_word_model() -> Callable[[str], list[dict]]:
    """Stand-in for a model: capitalised ASCII words are persons."""
    word = re.compile(r"\b[A-Z][a-z]{3,}\b")

    def predict(text: str) -> list[dict]:
        return [
            {"start": m.start(), "end": m.end(), "label": "PER", "score": 0.5, "lang": "nl"}
            for m in word.finditer(text)
        ]

    return predict


@query(
    "k2_model_backend",
    O.sql(
        [O.CORPUS, O.folded(), O.marked("x", EXTERNAL_RULES[:1]), O.positions("x")],
        "SELECT doc_id, s AS span_start, e AS span_end, 'PERSON' AS category, cast(0.9 AS DOUBLE) AS confidence, v AS value FROM x_v",
    ),
)
def k2(spark, sf_dir):
    docs = X.spans_from_model(C.corpus(spark, sf_dir), load_word_model)
    return EN.span_rows(EN.detect_spans(docs, "spacy")).selectExpr(*SPAN_COLS)


@query(
    "k2_udtf",
    O.sql(
        [O.CORPUS, O.folded(), O.marked("x", EXTERNAL_RULES[:1]), O.positions("x")],
        "SELECT doc_id, s AS span_start, e AS span_end, 'PERSON' AS category, cast(0.9 AS DOUBLE) AS confidence, v AS value FROM x_v",
    ),
)
def k2_udtf(spark, sf_dir):
    """The same model as a table function that SQL calls for each chunk of each text."""
    docs = C.corpus(spark, sf_dir)
    X.register_model(spark, "word_model", load_word_model)
    P.paragraph_chunks(docs).createOrReplaceTempView("k2_chunks")
    found = spark.sql(
        """SELECT c.doc_id, m.* FROM k2_chunks c, LATERAL word_model(c.text, c.chunk_start) m"""
    )
    return EN.span_rows(EN.detect_spans(docs, "spacy", found)).selectExpr(*SPAN_COLS)


# --- L: streams ---------------------------------------------------------------------------------


def corpus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and case files as one stream of files."""

    def stream(name: str, *columns: str) -> DataFrame:
        schema = C.table(spark, sf_dir, name).select(*columns).schema
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")

    return C.with_case_files(stream("documents", "doc_id", "text"), stream("customer", "c_custkey"))


@query(
    "l1_stream_redact",
    O.sql(
        KEPT_ONLY
        + [
            "edits AS (SELECT doc_id, s, e, '[' || category || ']' AS repl FROM kept)",
            O.rewritten("prepared", "edits"),
        ],
        "SELECT doc_id, sanitized FROM rewritten",
    ),
)
def l1(spark, sf_dir):
    out = scratch_path(spark, "stream")
    stream = encode_stream(corpus_stream(spark, sf_dir), "redact")
    (
        stream.select("doc_id", "sanitized")
        .writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/data")


@query(
    "l2_stream_replace",
    O.sql(
        O.encoded(False, D.HYBRID_ORDER) + [O.REPLACED, O.rewritten("prepared", "edits")],
        "SELECT doc_id, sanitized FROM rewritten",
    ),
)
def l2(spark, sf_dir):
    """Documents first, then case files: micro-batches share one mapping that grows."""
    out = scratch_path(spark, "stream")
    return replaced_stream(spark, sf_dir, out, encode_batches(spark, f"{out}/state", f"{out}/data"))


@query(
    "l2_stream_store",
    O.sql(
        O.encoded(False, D.HYBRID_ORDER) + [O.REPLACED, O.rewritten("prepared", "edits")],
        "SELECT doc_id, sanitized FROM rewritten",
    ),
)
def l2_store(spark, sf_dir):
    """The same by a stored mapping, of which a micro-batch reads the buckets of its keys."""
    out = scratch_path(spark, "stream")
    store = MappingStore(spark, f"{out}/store", n_buckets=16)
    return replaced_stream(spark, sf_dir, out, encode_into_store(store, f"{out}/data", "corpus"))


def replaced_stream(
    spark: SparkSession, sf_dir: str, out: str, step: Callable[[DataFrame, int], None]
) -> DataFrame:
    for texts in (C.documents(spark, sf_dir), C.case_files(spark, sf_dir)):
        texts.write.mode("append").parquet(f"{out}/in")
        (
            spark.readStream.schema(texts.schema)
            .parquet(f"{out}/in")
            .writeStream.foreachBatch(step)
            .option("checkpointLocation", f"{out}/progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{out}/data").select("doc_id", "sanitized")
