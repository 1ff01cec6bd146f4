"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One query runs before the others, unmeasured, so that none carries the start of the
session.  ``mb_per_core_second`` is the text read by all headline queries over their
time and the cores."""

import json
import os
import re
import time

from pyspark.sql import functions as F

from veilframe.operators.encode import encode
from veilframe.plans import corpus as C
from veilframe.plans.queries import QUERIES
from veilframe.session import session

HEADLINE = (
    "c2_emails",
    "c11_any_street",
    "c12_names",
    "c15_detect_all",
    "d2_resolve_overlaps",
    "e6_numbering",
    "g2_encode_documents",
    "g2_encode_corpus",
    "h1_decode_documents",
    "i1_statistics",
)


LONG_TEXT_FILES = 150  # case files put together as one document, some 170 KB


def one_long_text(spark, sf_dir):
    """The first case files as one document."""
    files = C.case_files(spark, sf_dir).where(
        F.col("doc_id") < C.CASE_BASE + LONG_TEXT_FILES
    )
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return files.agg(F.array_join(parts["text"], "\n").alias("text")).select(
        F.lit(1).cast("long").alias("doc_id"), "text"
    )


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": str(4 * int(cpus)),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.perf_counter()
    run(QUERIES["c2_emails"].run(spark, sf_dir))
    warm_up = round(time.perf_counter() - begin, 3)
    size = F.sum(F.octet_length("text")).alias("n")
    megabytes = C.corpus(spark, sf_dir).agg(size).first().n / 1e6
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        run(QUERIES[name].run(spark, sf_dir))
        times[name] = round(time.perf_counter() - begin, 3)
    long_text = one_long_text(spark, sf_dir)
    begin = time.perf_counter()
    run(encode(long_text).select("sanitized"))
    times["one_long_document"] = round(time.perf_counter() - begin, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
                "warm_up": warm_up,
                "mb": round(megabytes, 1),
                "mb_per_core_second": round(
                    megabytes * len(HEADLINE) / sum(times[n] for n in HEADLINE) / int(cpus), 4
                ),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
