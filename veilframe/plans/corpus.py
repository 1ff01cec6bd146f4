"""Input texts of the registered queries, derived from the given tables.

``CASE_TEXT`` writes one case file per customer in SQL that Spark and other
engines evaluate alike; it holds at least one hit for every detector and repeats
names, numbers and places across customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_BASE = 1_000_000_000  # case files are numbered above all documents

_K = "c_custkey"


def _digits(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


def _pick(words: str, expr: str) -> str:
    n = words.count("|") + 1
    return f"split_part('{words}', '|', cast(({expr}) % {n} as int) + 1)"


FIRST = _pick("Hendrik|Joris|Lucas|Tarik|Bavo|Ruben|Mattias|Simon|Kas|Noor|Elke", _K)
LAST = _pick("Vermeulen|Desmet|Lambert|Aerts|Pauwels|Hermans|Willems|Stevens", f"{_K} * 3")
CAPS = _pick("HAMDAOUI|OOSTEREN|KLEIN|DEKKER|BOER|VISSER", f"{_K} * 5")
CITY = _pick("Lelystad|Wuustwezel|Gent|Breda|Molenbeek|Sint-Jans-Molenbeek|Liège|Knokke", f"{_K} * 7")
TOWN = _pick("GENT|BREDA|ANTWERPEN|WUUSTWEZEL", f"{_K} + 1")
BORN = f"concat({_digits(f'{_K} % 28 + 1', 2)}, '/', {_digits(f'{_K} % 12 + 1', 2)}, '/19', {_digits(f'{_K} % 60 + 30', 2)})"
BORN_DASH = f"concat({_digits(f'{_K} % 28 + 1', 2)}, '-', {_digits(f'{_K} % 12 + 1', 2)}, '-19', {_digits(f'{_K} % 60 + 30', 2)})"
PHONE6 = _digits(f"({_K} * 7919) % 400 + 100000", 6)
ACCOUNT = f"concat({_digits(f'{_K} % 90 + 10', 2)}, ' ', {_digits(f'{_K} % 250', 4)}, ' ', {_digits(f'{_K} * 13 % 10000', 4)}, ' ', {_digits(f'{_K} * 17 % 10000', 4)})"
NL = "chr(10)"

CASE_LINES = (
    f"'DOSSIER ', cast({_K} as string), ' - AFDELING ', {TOWN}",
    f"'DE {{caps}} ', {FIRST}, ' - ', {BORN_DASH}, ' - Nationaliteit : Belgisch'",
    f"'Mr. ', {FIRST}, ' ', {LAST}, ', geboren op ', {BORN}, ' te ', {CITY}",
    "'aangetroffen op 16/10/2023 in ', {city}, ' en bij Vosselaar, né le 01.02.1980'",
    f"'Tel: 0476/', substr({PHONE6}, 1, 2), '.', substr({PHONE6}, 3, 2), '.', substr({PHONE6}, 5, 2), ' of +32476', {PHONE6}, ' of 32476', {PHONE6}, ', (555) 123-', {_digits(f'{_K} % 200', 4)}",
    f"'Mail: user', cast({_K} % 97 as string), '@example.com, fooxx', cast({_K} % 10 as string), '@example.com'",
    f"'Bankrekening: BE', {ACCOUNT}, ' of BE', replace({ACCOUNT}, ' ', ''), ' of NL12TESTXX34567'",
    f"'bsn ', {_digits(f'{_K} * 7919 + 100000000', 9)}, ' en ref ', {_digits(f'{_K} * 104729 + 200000000', 9)}, ', ssn 321-54-', {_digits(f'{_K} % 5000', 4)}, ', passport KL', {_digits(f'{_K} % 999', 6)}",
    f"'88.11.07-', {_digits(f'{_K} % 900 + 100', 3)}, '.45 en rijksregisternummer 88110712', {_digits(f'{_K} % 900 + 100', 3)}, ', KL 21 43 65 D, Y-7654321-B'",
    f"'Rijdt ', {_pick('een Fiat Ducato|een Fiat Mini Cooper|de Sprinter|een BMW X5|Mercedes-Benz Vito|een Renault Trucks T', f'{_K} * 11')}, ' over de N', cast({_K} % 900 + 1 as string), ' en e40'",
    f"'via de Kampweg richting ', {CITY}, ', naar Vosselaar, t.h.v. ', {TOWN}, ' 2990, op de Grote Markt'",
    f"{_pick('Stationstraat|Koningin Mirandalaan|Kampweg|Hauptstrasse', _K)}, ' ', cast({_K} % 90 + 1 as string), ', 9', {_digits(f'{_K} % 1000', 3)}, ' ', {CITY}, ', 4321 KL ', {CITY}",
    f"cast({_K} % 90 + 1 as string), ' High Street, ', cast({_K} % 50 + 1 as string), ' rue de la Paix, 75001 Saint-Denis, Springfield, IL 62704, SW1A 1AA'",
    f"'vader van VAN', {NL}, '{{caps}} ', {FIRST}, ', zoon Jean-Pierre ', {LAST}, ' en von der ', {LAST}, ' en ', {FIRST}, ' {{caps}} en O''Neill en VAN EERSTE AANLEG'",
    f"'VANDERHEYDEN ', {FIRST}, ' geboren te Gent; KLAASSEN Nationaliteit Belg; Mika Toru Vana PERSON_', {_digits(f'{_K} % 1000', 3)}, ' en ORG_001s ID_12 PERSON_10000'",
    "'verklaring over verhuring aan de Groenplaats, onderweg op het fietspad bij Café*** Zuid'",
)



def _case_text() -> str:
    parts: list[str] = []
    for i, line in enumerate(CASE_LINES):
        if i:
            parts.append(NL)
        line = line.replace("'DE {caps} '", f"'DE ', {CAPS}, ' '")
        line = line.replace("'{caps} '", f"{CAPS}, ' '").replace("' {caps} en ", f"' ', {CAPS}, ' en ")
        line = line.replace("{city}", CITY)
        parts.append(line)
    return "concat(" + ", ".join(parts) + ")"


CASE_TEXT = _case_text()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Detection is compute-bound, and the small files of the test tables are read as one
    split each: their rows are dealt out to as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    return customers.select(
        (F.col("c_custkey") + CASE_BASE).alias("doc_id"), F.expr(CASE_TEXT).alias("text")
    )


def with_case_files(documents: DataFrame, customers: DataFrame) -> DataFrame:
    """Documents and a case file per customer, of tables or of streams.

    Keys and texts are dealt out together and case files written after, so that what
    follows is one expression in one set of tasks: detection over a union of the two would
    stand in the plan twice, and every task reads and compiles the plan anew."""
    rows = documents.select(
        F.lit(False).alias("_is_case"), "doc_id", "text", F.lit(None).cast("long").alias("c_custkey")
    ).unionByName(customers.select(F.lit(True).alias("_is_case"), "c_custkey"), allowMissingColumns=True)
    return spread(rows).select(
        F.when(F.col("_is_case"), F.col("c_custkey") + CASE_BASE).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("_is_case"), F.expr(CASE_TEXT)).otherwise(F.col("text")).alias("text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and one case file per customer."""
    return with_case_files(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "customer").select("c_custkey"),
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages, one turn a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        "text",
    )
