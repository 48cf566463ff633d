import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("pagegrain-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def column(spark):
    """Run a Column function over Python values and return the results in order."""

    def run(fn, inputs, schema="v string"):
        rows = [(at, *(v if isinstance(v, tuple) else (v,))) for at, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"_at int, {schema}")
        names = [name for name in df.columns if name != "_at"]
        out = df.select("_at", fn(*[df[name] for name in names]).alias("out")).collect()
        return [row["out"] for row in sorted(out, key=lambda row: row["_at"])]

    return run
