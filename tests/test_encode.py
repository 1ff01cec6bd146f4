import pytest
from pyspark.sql import functions as F

from veilframe.operators import decode as DE
from veilframe.operators import encode as EN
from veilframe.operators import entities as E
from veilframe.operators import reports as RE

RENTAL = """
STADSKANTOOR, balie voor verhuur
Bel 076/41.22.90, post an.koster@verhuur.example.org

KUIPERS Floris Daan, geboren op 14/02/1987 te Breda, huurder sinds kort

Op 03/05/2022 stonden er 40 fietsen in de kelder.
DE WILDE Arne - 11-08-1991 - Nationaliteit : Belgisch
DE WILDE Stijn is broer van DE
WILDE Arne en Karel
Nummer 32476200300, rekening BE12 3456 7890 1234, of +32 9 221 55 70.
"""


def one(df):
    row = df.first()
    return row, {m["placeholder"]: m for m in row.mapping}


@pytest.fixture(scope="module", params=["hybrid", "patterns"])
def rental(request, texts):
    df = EN.encode(texts(RENTAL), backend=request.param).select(
        "doc_id", "text", "sanitized", "mapping"
    )
    row, mapping = one(df)
    return row.sanitized, mapping


def test_values_go_and_structure_stays(rental):
    sanitized, _ = rental
    for gone in (
        "076/41.22.90", "32476200300", "+32 9 221 55 70", "an.koster@verhuur.example.org",
        "BE12 3456 7890 1234", "14/02/1987", "KUIPERS Floris", "WILDE Arne", "WILDE Stijn",
    ):
        assert gone not in sanitized
    for kept in ("broer van", "geboren op", " en ", "40 fietsen", "03/05/2022"):
        assert kept in sanitized
    for prefix in ("PERSON_", "PHONE_", "EMAIL_", "IBAN_", "DOB_", "PLACE_"):
        assert prefix in sanitized


def test_same_value_same_placeholder_and_numbers_from_the_end(rental):
    sanitized, mapping = rental
    arne = [p for p, m in mapping.items() if m["norm_key"] == "ARNE|WILDE"]
    assert len(arne) == 1 and sanitized.count(arne[0]) == 2
    assert mapping[arne[0]]["occurrences"] == 2
    assert mapping["IBAN_001"]["canonical"] == "BE12 3456 7890 1234"
    last = max((sanitized.rfind(p), p) for p in mapping if p.startswith("PERSON_"))
    assert last[1] == "PERSON_001"


def test_decode_restores(spark, texts):
    encoded = EN.encode(texts(RENTAL)).select(F.col("text").alias("joined"), "sanitized", "mapping")
    decoded = DE.decode(
        encoded.select("joined", F.col("sanitized").alias("text"), "mapping")
    ).first()
    assert decoded.decoded == decoded.joined  # joined lines are not split again
    assert "DE WILDE Arne en" in decoded.decoded


@pytest.mark.parametrize("text", ["", "This is a plain text with nothing to hide."])
def test_clean_text_is_untouched(texts, text):
    row, mapping = one(EN.encode(texts(text)))
    assert row.sanitized == text and mapping == {}


def test_null_text_stays_null(texts):
    row = EN.encode(texts(None, "x@y.com").orderBy("doc_id")).orderBy("doc_id").first()
    assert row.sanitized is None


def test_masked_values_are_skipped_unless_asked(texts):
    df = texts("mail fooxx@example.com")
    assert one(EN.encode(df))[0].sanitized == "mail fooxx@example.com"
    assert one(EN.encode(df, skip_already_masked=False))[0].sanitized == "mail EMAIL_001"


def test_strategies_keep_a_mapping(texts):
    df = texts("mail jan@example.com, tel 0489/66.70.88")
    row, mapping = one(EN.encode(df, strategy="mask"))
    assert row.sanitized == "mail j**@e******.com, tel 04**/**.**.88"
    assert set(mapping) == {"EMAIL_001", "PHONE_001"}
    assert one(EN.encode(df, strategy="redact"))[0].sanitized == "mail [EMAIL], tel [PHONE]"
    with pytest.raises(ValueError):
        EN.encode(df, strategy="encrypt")
    with pytest.raises(ValueError):
        EN.encode(df, strategy="unknown")
    with pytest.raises(ValueError):
        EN.encode(df, backend="unknown")
    with pytest.raises(ValueError):
        EN.encode(df, backend="spacy")


def test_corpus_mapping_is_shared_and_grows(spark, texts):
    first = texts("Bel 0489/66.70.88 of +32489667088", "mail a@b.com, a@b.com")
    encoded = EN.encode_corpus(first)
    rows = {r.doc_id: r.sanitized for r in encoded.documents.collect()}
    assert rows == {0: "Bel PHONE_001 of PHONE_001", 1: "mail EMAIL_001, EMAIL_001"}
    second = spark.createDataFrame(
        [(7, "mail A@B.com en c@d.com, 32489667088")], "doc_id long, text string"
    )
    grown = EN.encode_corpus(second, mapping=encoded.mapping, forms=encoded.forms)
    assert grown.documents.first().sanitized == "mail EMAIL_001 en EMAIL_002, PHONE_002"
    entries = {r.placeholder: r for r in grown.mapping.collect()}
    assert entries["EMAIL_001"].occurrences == 3 and entries["EMAIL_001"].n_variations == 2
    back = DE.decode_corpus(
        grown.documents.select("doc_id", F.col("sanitized").alias("text")), grown.mapping
    )
    assert back.first().decoded == "mail a@b.com en c@d.com, 32489667088"


def test_numbers_do_not_depend_on_partitions(spark):
    rows = [(d, s, s + 3, "PERSON" if s % 2 else "PLACE", f"v{(d * 7 + s) % 500}") for d in range(300) for s in range(0, 50, 5)]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, category string, value string")
    seen, expected, counters = {}, {}, {}
    for d, s, e, c, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        key = v.upper()
        if key not in seen:
            counters[c] = counters.get(c, 0) + 1
            seen[key] = f"{c}_{counters[c]:03d}"
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        mapping, _ = E.build_mapping(spans.repartition(int(n)))
        assert {r.norm_key: r.placeholder for r in mapping.collect()} == seen
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key")
    )
    table = rows.select("key").distinct().where("key <> 'k1'").withColumn("v", F.length("key"))
    joined = E.lookup(rows, table, "key")
    assert joined.count() == 9000
    assert joined.where("v is null").count() == 1
    assert joined.where("key = 'hot' and v = 3").count() == 3000


def test_external_spans_fill_gaps_only(spark, texts):
    df = texts("Mail a@b.com van Kofi Mensah")
    ext = spark.createDataFrame(
        [(0, 5, 12, "PER", 0.9, "nl"), (0, 17, 28, "PER", 0.9, "nl"), (0, 17, 21, "LOC", 0.9, "nl"),
         (0, 0, 4, "ORG", 0.9, "nl")],
        "doc_id long, start int, end int, label string, score double, lang string",
    )
    plain = [s["value"] for s in EN.detect_spans(df, "hybrid").first().spans]
    more = EN.detect_spans(df, "hybrid", ext).first().spans
    assert "a@b.com" in plain
    assert [s["value"] for s in more if s["category"] == "EMAIL"] == ["a@b.com"]
    assert all(a["end"] <= b["start"] for a, b in zip(more, more[1:]))
    # Model spans that overlap are resolved before they could corrupt the text.
    flat = EN.detect_spans(df, "spacy", ext).first().spans
    assert [s["value"] for s in flat] == ["Mail", "a@b.com", "Kofi Mensah"]


def test_legend_and_statistics(spark, texts):
    row = EN.encode(texts("a@b.com en c@d.com te Gent"), legend=True).first()
    head, _, body = row.sanitized.partition("IMPORTANT")
    assert "  EMAIL_NNN : Email addresses (2 unique)\n  PLACE_NNN : Locations" in head
    assert body.endswith("=" * 60 + "\nEMAIL_002 en EMAIL_001 te PLACE_001")
    mapping = EN.encode_corpus(texts("a@b.com en " + "yz" * 15 + "@d.com, a@b.com")).mapping
    stats = {r.category: r for r in RE.statistics(mapping).collect()}
    assert stats[None].unique_values == 2 and stats[None].occurrences == 3
    assert stats["EMAIL"].examples == "EMAIL_001 → a@b.com; EMAIL_002 → " + "yz" * 15 + "..."


def test_ids_that_are_null_or_repeat(spark):
    rows = [(None, "mail a@b.com"), (2, "bel 0476/66.70.88"), (2, "mail c@d.com en a@b.com"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = EN.encode_corpus(docs)
    got = sorted(str(r.sanitized) for r in encoded.documents.collect())
    assert got == ["None", "bel PHONE_001", "mail EMAIL_001", "mail EMAIL_002 en EMAIL_001"]
    back = DE.decode_corpus(
        encoded.documents.select("doc_id", F.col("sanitized").alias("text")), encoded.mapping
    )
    assert sorted(str(r.decoded) for r in back.collect()) == sorted(str(t) for _, t in rows)
    assert not [c for c in back.columns if c.startswith("_")]
    span = [(2, 0, 4, "PER", 0.9, "nl")]
    schema = "doc_id long, start int, end int, label string, score double, lang string"
    with pytest.raises(ValueError):
        EN.encode_corpus(docs, external=spark.createDataFrame(span, schema))
    with pytest.raises(ValueError):
        EN.encode_corpus(docs, external=spark.createDataFrame([(None, *span[0][1:])], schema))


def test_decode_knows_no_largest_number(spark, texts):
    mapping = spark.createDataFrame(
        [("ID_9999", "a"), ("ID_10000", "b"), ("DATE_001", "c"), ("CREDIT_CARD_123456", "d")],
        "placeholder string, canonical string",
    )
    text = "ID_9999 ID_10000 DATE_001 CREDIT_CARD_123456 ID_10001 X_ID_9999 ID_99999s"
    assert DE.decode_corpus(texts(text), mapping).first().decoded == "a b c d ID_10001 X_ID_9999 ID_99999s"
    assert DE.decode_corpus(texts(text), mapping, max_digits=4).first().decoded == text.replace("ID_9999 ", "a ", 1)
    own = texts(text).withColumn(
        "mapping", F.array(*[F.struct(F.lit(p).alias("placeholder"), F.lit(c).alias("canonical")) for p, c in (("ID_10000", "b"), ("DATE_001", ""))])
    )
    assert DE.decode(own).first().decoded == text.replace("ID_10000 ", "b ", 1)


def plain_splice(text, edits):
    for start, end, value in reversed(edits):
        text = text[:start] + value + text[end:]
    return text


@pytest.mark.parametrize("length,step", [(0, 7), (5, 2), (1023, 50), (1024, 3), (5000, 911), (9000, 4000), (3000, 1)])
def test_splice_at_all_places(spark, length, step):
    from veilframe.functions.rewrite import splice

    text = "".join(chr(97 + i % 26) if i % 5 else "é😀"[i % 2] for i in range(length))
    edits = [(i, min(length, i + max(1, step // 2)), f"<{i}>") for i in range(0, length, step)]
    rows = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(v).alias("replacement")) for s, e, v in edits[:400]])
    if not edits:
        rows = rows.cast("array<struct<start:int,end:int,replacement:string>>")
    got = spark.range(1).select(splice(F.lit(text), rows)).first()[0]
    assert got == plain_splice(text, edits[:400])


def test_a_document_extends_a_known_mapping(texts):
    first = EN.encode(texts("mail a@b.com en c@d.com te Gent")).select(
        "doc_id", F.col("mapping").alias("known"), F.lit("mail e@f.com, A@B.com, c@d.com te Breda").alias("text")
    )
    row, mapping = one(EN.encode(first, known="known"))
    assert row.sanitized == "mail EMAIL_003, EMAIL_002, EMAIL_001 te PLACE_002"
    assert {p: (m["num"], m["occurrences"], m["variations"]) for p, m in mapping.items()} == {
        "EMAIL_001": (1, 2, ["c@d.com"]), "EMAIL_002": (2, 2, ["A@B.com", "a@b.com"]),
        "EMAIL_003": (3, 1, ["e@f.com"]), "PLACE_001": (1, 1, ["Gent"]), "PLACE_002": (2, 1, ["Breda"]),
    }
    again = one(EN.encode(first.withColumn("text", F.lit("niets")), known="known"))[1]
    assert {p: m["occurrences"] for p, m in again.items()} == {"EMAIL_001": 1, "EMAIL_002": 1, "PLACE_001": 1}


@pytest.mark.parametrize("more", [-1, 0, 1])
def test_splice_of_texts_about_as_long_as_are_cut_at_once(spark, more):
    """Up to there no blocks are made."""
    from veilframe.functions import rewrite as RW

    text = ("aé😀-" * RW.SHORT)[: RW.SHORT + more]
    edits = [(0, 2, "X"), (1020, 1030, ""), (2048, 2048, "in"), (RW.SHORT - 3, len(text), "end")]
    rows = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in edits])
    assert spark.range(1).select(RW.splice(F.lit(text), rows)).first()[0] == plain_splice(text, edits)


def test_entities_without_a_mapping_are_not_searched_for_known_ones(texts):
    """Before, those of a category were picked out three times over, to look for known ones."""
    docs = texts("a").select(F.array().cast(f"array<{E.ITEM_TYPE}>").alias("items"))
    plan = docs.select(E.entities_in_row(F.col("items")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") <= 4  # 12 before
