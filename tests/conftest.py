import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from reviewloom.session import ensure_package

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_package(s)
    yield s
    s.stop()


MINI = [
    (1, "B000000001", "Good: very GOOD tea/coffee, 10x better", "5.0", "3/4"),
    (2, "B000000001", "bad", "4.5", "0/0"),
    (3, "B000000002", "Good coffee; not the best coffee.", "1.0", "1/2"),
    (4, "B000000003", "", "3.0", "0/0"),
    (5, "B000000003", "it's tea - tea & more tea!", "2.0", "2/2"),
]


@pytest.fixture(scope="session")
def mini(spark):
    """The golden corpus as typed review rows."""
    from reviewloom.operators.build import review_table

    raw = spark.createDataFrame(MINI, "review_id bigint, product_id string, text string, score string, helpfulness string")
    return review_table(raw).join(raw.select("review_id", "text"), "review_id").cache()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
