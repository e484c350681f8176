import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from linkweave.session import prepare

    session = (
        SparkSession.builder.master("local[4]")
        .appName("linkweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        # small inputs stay in several pieces, as large ones do
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values."""
    from pyspark.sql import functions as F

    def run(function, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1)
        return [r[1] for r in sorted(rows.select("i", function(F.col("v")).alias("out")).collect())]

    return run
