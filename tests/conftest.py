import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from recordrisk.workspace import ship_package  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("recordrisk-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")  # a test puts spark.checkpoint.dir elsewhere for a while
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recordrisk-test-"))
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def by_id(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}")
