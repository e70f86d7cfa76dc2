import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a, b", (1, 2), (3, 4)): all-text rows under the given headers."""

    def build(headers, *rows):
        names = [h.strip() for h in headers.split(",")]
        schema = ", ".join(f"`{n}` string" for n in names)
        return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], schema)

    return build
