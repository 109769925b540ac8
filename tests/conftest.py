import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

# columns are built while tests are collected, which needs a session
SESSION = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def ask(spark):
    """ask(values, schema, *columns): the rows of a select over literal rows."""

    def run(values, schema, *columns):
        return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]

    return run
