import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.driver.memory", "2g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from tests.data import CATALOG

    return spark.createDataFrame(CATALOG, "doc_id string, name string, description string, category string").cache()


@pytest.fixture(scope="session")
def engine(catalog):
    from lexiloom.operators.analysis import catalog_text
    from lexiloom.operators.index import Engine

    return Engine(catalog_text(catalog).select("doc_id", "text", "name"))


@pytest.fixture(scope="session")
def evalset(spark):
    from tests.data import QRELS, QUERIES

    return spark.createDataFrame(QUERIES, "query string, family string, expected_patch_kinds array<string>").cache(), spark.createDataFrame(QRELS, "query string, doc_id string, grade int").cache()
