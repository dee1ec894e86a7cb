import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import threatlog

    threatlog.tune(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    """Lines from a list of texts."""

    def make(texts, source="s"):
        rows = [(n, source, text) for n, text in enumerate(texts, start=1)]
        return spark.createDataFrame(rows, "seq bigint, source string, line string")

    return make
