import json
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import keys as K
from veilframe.functions import strategies as ST
from veilframe.functions.text import first_difference, join_broken_names, strip
from veilframe.operators import encode as EN
from veilframe.operators import entities as E
from veilframe.operators import external as X
from veilframe.operators import pages as P
from veilframe.operators import reports as RE
from veilframe.sources import files as SF
from veilframe.streaming.encode import encode_batches, encode_stream


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_masks(spark):
    cases = [
        (ST.mask_words(F.lit("Jan de Vries")), "*** ** V**es"),
        (ST.mask_words(F.lit("Vries"), "#", 0, 0), "#####"),
        (ST.mask_email(F.lit("jan@example.com")), "j**@e******.com"),
        (ST.mask_email(F.lit("jan@host")), "j**@****"),
        (ST.mask_email(F.lit("nobody")), "n***dy"),
        (ST.mask_phone(F.lit("0612345678")), "06******78"),
        (ST.mask_phone(F.lit("+32 3 2")), "*******"),
        (ST.mask_iban(F.lit("BE44 3770 8065 6345")), "BE44 **** **** 6345"),
        (ST.mask_iban(F.lit("BE44")), "****"),
    ]
    for column, expected in cases:
        assert value(spark, column) == expected


def test_hash_and_encrypt(spark):
    import hashlib

    v, c = F.lit("Jan"), F.lit("PERSON")
    assert value(spark, ST.strategy_fn("hash", salt="s")(v, c)) == hashlib.sha256(b"sJanPERSON").hexdigest()[:16]
    assert value(spark, ST.strategy_fn("hash", algorithm="md5", truncate=None)(v, c)) == hashlib.md5(b"JanPERSON").hexdigest()
    key = "0123456789abcdef"
    token = ST.strategy_fn("encrypt", key=key)(v, c)
    assert value(spark, ST.decrypt(token, key)) == "Jan"
    assert ST.can_deanonymize("replace") and not ST.can_deanonymize("mask")


def test_keys(spark):
    assert value(spark, K.name_key(F.lit("El Hamdaoui  Tarik"))) == "HAMDAOUI|TARIK"
    assert value(spark, K.name_key(F.lit("DE LA"))) == ""
    assert value(spark, K.phone_key(F.lit("0032 489/66"))) == "+3248966"
    assert value(spark, K.phone_key(F.lit("0489/66.70.88"))) == "+32489667088"
    assert value(spark, K.placeholder(F.lit("ID"), F.lit(1234))) == "ID_1234"


def test_text_helpers(spark):
    assert value(spark, strip(F.lit(" \n a b\t\n"))) == "a b"
    assert value(spark, join_broken_names(F.lit("DE\nDE\nX, VAN\nOosteren"))) == "DE DE\nX, VAN Oosteren"
    for a, b in (("abc", "abd"), ("abc", "ab"), ("x" * 999 + "y", "x" * 999 + "z"), ("a", "b")):
        expected = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), None)
        assert value(spark, first_difference(F.lit(a), F.lit(b))) == expected


def test_pages(spark, texts):
    pages = spark.createDataFrame(
        [(1, 2, "two"), (1, 1, "one " * 20), (1, 3, "  ")], "doc_id long, page_no int, text string"
    )
    whole = P.assemble_pages(pages)
    assert whole.first().text == "--- Page 1 ---\n" + "one " * 20 + "\n\n--- Page 2 ---\ntwo\n\n--- Page 3 ---\n  "
    assert [(r.page_no, r.text) for r in P.split_pages(whole).orderBy("page_no").collect()] == [
        (1, ("one " * 20).strip()), (2, "two")
    ]
    assert [r.text for r in P.page_parts(whole, 1).orderBy("part_no").collect()][1] == "two"
    report = P.convert_report(pages).first()
    assert (report.total_pages, report.scan_pages, report.native_pages, report.ocr_pages) == (3, 2, 3, 0)
    assert report.text_length == len(whole.first().text)
    blank = texts("--- Page 1 ---\n \n")
    assert [r.text for r in P.page_parts(blank, 2, 10).orderBy("part_no").collect()] == ["--- Page 1\n\n ---\n \n"]
    assert P.page_parts(texts("no marker")).first().text == "no marker"
    assert P.page_parts(texts("")).count() == 0


def reference_chunks(text, size):
    out, pos = [], 0
    while pos < len(text):
        end = min(pos + size, len(text))
        if end < len(text):
            para, sent = text.rfind("\n\n", pos, end), text.rfind(". ", pos, end)
            if para > pos + size // 2:
                end = para + 2
            elif sent > pos + size // 2:
                end = sent + 2
        out.append((pos, end))
        pos = end
    return out


def test_paragraph_chunks(texts):
    text = "".join(f"Sentence {i}. " + ("\n\n" if i % 7 == 0 else "") + "x" * (i % 23) for i in range(200))
    for size in (20, 55, 300, 10_000):
        rows = P.paragraph_chunks(texts(text), size).orderBy("chunk_no").collect()
        assert [(r.chunk_start, r.chunk_end) for r in rows] == reference_chunks(text, size)
        assert "".join(r.text for r in rows) == text


def test_languages(spark):
    assert value(spark, X.language_code(F.lit(" Vlaams "))) == "nl"
    assert value(spark, X.language_code(F.lit("xx"))) is None
    assert X.require_language("Français") == "fr"
    with pytest.raises(ValueError):
        X.require_language("klingon")


def test_mapping_files(spark, texts, tmp_path):
    encoded = EN.encode(texts("a@b.com, A@b.com te Gent"))
    text = encoded.select(SF.mapping_json(F.col("mapping"))).first()[0]
    stored = json.loads(text)
    assert stored["statistics"] == {"PLACE": 1, "EMAIL": 1}
    assert stored["mappings"]["EMAIL_001"] == {
        "canonical": "A@b.com", "variations": ["A@b.com", "a@b.com"], "occurrences": 2
    }
    (tmp_path / "m.json").write_text(text)
    loaded = {r.placeholder: r for r in SF.read_mapping(spark, str(tmp_path / "m.json")).collect()}
    assert loaded["EMAIL_001"].norm_key == "A@B.COM" and loaded["EMAIL_001"].num == 1
    (tmp_path / "old.json").write_text('{"mappings": {"PERSON_002": {"canonical": "Jan Maes"}}}')
    row = SF.read_mapping(spark, str(tmp_path / "old.json")).first()
    assert (row.version, row.created, row.variations, row.occurrences) == ("1.0", "", ["Jan Maes"], 1)
    (tmp_path / "other.json").write_text('{"entries": {"PERSON_002": {"canonical": "Jan Maes"}}}')
    assert SF.read_mapping(spark, str(tmp_path / "other.json")).count() == 0


def test_shared_mapping_as_one_json_file(spark, texts, tmp_path):
    encoded = EN.encode_corpus(texts("a@b.com, A@b.com te Gent", 'mail c@d.com en "Jan MAES"'))
    SF.write_mapping(encoded.mapping, encoded.forms, str(tmp_path / "map"), "2024")
    parts = sorted((tmp_path / "map").glob("part-*"))
    stored = json.loads("".join(p.read_text() for p in parts))
    assert set(stored["mappings"]) == {r.placeholder for r in encoded.mapping.collect()}
    assert stored["mappings"]["EMAIL_001"]["variations"] == ["A@b.com", "a@b.com"]
    loaded = SF.read_mapping_lines(spark, str(tmp_path / "map"))
    assert loaded.count() == len(stored["mappings"])
    assert loaded.where("is_lookup").count() == len(stored["mappings"])


def test_batch_on_top_of_a_stored_mapping(spark, texts, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"mappings": {
        "EMAIL_003": {"canonical": "a@b.com", "variations": ["a@b.com", "A@b.com"], "occurrences": 4},
        "EMAIL_007": {"canonical": "A@B.com"},
        "PERSON_002": {"canonical": "Jan Maes"},
    }}))
    stored = SF.read_mapping(spark, str(tmp_path / "m.json"))
    more = EN.encode_corpus(
        texts("mail A@B.COM of new@b.com"), mapping=stored, forms=E.stored_forms(stored)
    )
    assert more.documents.first().sanitized == "mail EMAIL_007 of EMAIL_008"
    rows = {r.placeholder: r for r in more.mapping.collect()}
    assert set(rows) == {"EMAIL_003", "EMAIL_007", "EMAIL_008", "PERSON_002"}
    assert (rows["EMAIL_007"].occurrences, rows["EMAIL_007"].n_variations) == (2, 2)
    assert rows["EMAIL_003"].occurrences == 4
    SF.write_mapping(more.mapping, more.forms, str(tmp_path / "grown"), "2024")
    again = {r.placeholder: r for r in SF.read_mapping_lines(spark, str(tmp_path / "grown")).collect()}
    assert again["EMAIL_003"].variations == ["A@b.com", "a@b.com"] and again["EMAIL_003"].occurrences == 4
    assert again["EMAIL_007"].variations == ["A@B.COM", "A@B.com"]
    assert again["PERSON_002"].variations == ["Jan Maes"]
    stored = SF.read_mapping_lines(spark, str(tmp_path / "grown"))
    same = EN.encode_corpus(texts("niets"), mapping=stored, forms=E.stored_forms(stored))
    SF.write_mapping(same.mapping, same.forms, str(tmp_path / "same"), "2024")
    lines = [sorted(r.value for r in spark.read.text(str(tmp_path / d)).collect()) for d in ("grown", "same")]
    assert lines[0] == lines[1]
    with pytest.raises(ValueError):
        EN.encode_corpus(texts("niets"), mapping=stored)


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "case.one.txt").write_text("mail a@b.com\nregel twee")
    docs = SF.read_texts(spark, str(tmp_path / "in"))
    row = docs.first()
    assert (row.stem, row.suffix, row.text) == ("case.one", ".txt", "mail a@b.com\nregel twee")
    encoded = EN.encode(docs).withColumn(
        "output_name", SF.output_name(F.col("stem"), F.col("suffix"), "sanitized")
    )
    SF.write_texts(encoded, str(tmp_path / "out"))
    written = list((tmp_path / "out").glob("output_name=case.one_sanitized.txt/part-*"))
    assert [p.read_text() for p in written if p.stat().st_size] == ["mail EMAIL_001\nregel twee\n"]
    size = SF.binary_info(spark, str(tmp_path / "in")).first().size_mb
    assert size == 23 / 1048576


def test_custom_strategy_and_model(spark, texts):
    ST.register_strategy("upper", lambda: lambda v, c: F.upper(v))
    assert EN.encode(texts("mail a@b.com"), strategy="upper").first().sanitized == "mail A@B.COM"

    def load():
        word = re.compile("[A-Z][a-z]+")
        return lambda t: [
            {"start": m.start(), "end": m.end(), "label": "PER", "score": 1.0, "lang": "nl"}
            for m in word.finditer(t)
        ]

    docs = X.spans_from_model(texts("hier is Kofi", None), load)
    rows = EN.encode(docs, backend="spacy").orderBy("doc_id").collect()
    assert [r.sanitized for r in rows] == ["hier is PERSON_001", None]


def test_label_tables(spark):
    tables = RE.label_tables(spark)
    assert tables.where("backend = 'default_labels'").count() == 14
    assert tables.where("backend = 'extended_labels'").count() == 24


def test_streams(spark, texts, tmp_path):
    for i, t in enumerate(("bel 0489/66.70.88", "bel +32489667088 of a@b.com")):
        spark.createDataFrame([(i, t)], "doc_id long, text string").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))

    def source():
        return (
            spark.readStream.schema("doc_id long, text string")
            .option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in"))
        )

    with pytest.raises(ValueError):
        encode_stream(source(), "replace")
    encode_stream(source()).writeStream.format("memory").queryName("redacted").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert {r.sanitized for r in spark.table("redacted").collect()} == {
        "bel [PHONE]", "bel [PHONE] of [EMAIL]"
    }
    step = encode_batches(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    source().writeStream.foreachBatch(step).option(
        "checkpointLocation", str(tmp_path / "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.sanitized for r in rows} == {
        0: "bel PHONE_001", 1: "bel PHONE_001 of EMAIL_001"
    }


def test_state_of_batches(spark, texts, tmp_path, monkeypatch):
    from veilframe.streaming import encode as SE

    monkeypatch.setattr(SE, "SNAPSHOT", 2)
    state = str(tmp_path / "state")
    start = EN.encode_corpus(texts("mail a@b.com"))
    step = encode_batches(spark, state, str(tmp_path / "out"), mapping=start.mapping, forms=start.forms)
    batches = [texts("A@b.com"), texts("c@d.com"), texts("a@b.com en c@d.com"), texts("e@f.com"), texts("niets")]
    for i, batch in enumerate(batches):
        step(batch, i)
        step(batch, i)  # run again
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.batch: r.sanitized for r in rows} == {
        0: "EMAIL_001", 1: "EMAIL_002", 2: "EMAIL_001 en EMAIL_002", 3: "EMAIL_003", 4: "niets"
    }
    mapping, forms = SE.read_state(spark, state, 4)
    assert {r.placeholder: (r.occurrences, r.n_variations) for r in mapping.collect()} == {
        "EMAIL_001": (3, 2), "EMAIL_002": (2, 1), "EMAIL_003": (1, 1)
    }
    assert {(r.value, r.occurrences) for r in forms.collect()} == {
        ("a@b.com", 2), ("A@b.com", 1), ("c@d.com", 2), ("e@f.com", 1)
    }
    assert sorted(p.name for p in (tmp_path / "state" / "forms").iterdir()) == [f"version={v}" for v in (2, 3, 4)]
