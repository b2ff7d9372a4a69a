import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tablecare.session import get_spark

    session = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def large(spark):
    """Every table counts as large, and long keys are cut every 40 rows."""
    spark.conf.set("spark.tablecare.smallRows", "0")
    spark.conf.set("spark.tablecare.blockRows", "40")
    yield spark
    spark.conf.unset("spark.tablecare.smallRows")
    spark.conf.unset("spark.tablecare.blockRows")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
