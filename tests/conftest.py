import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veilframe.session import session

    spark = session(
        app="tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """DataFrame of documents from plain strings."""

    def make(*values):
        return spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], "doc_id long, text string"
        )

    return make
