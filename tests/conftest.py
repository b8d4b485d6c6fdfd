import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COMPANY = "company_id string, name string, description string, company_size string, state string, country string, city string, zip_code string, address string, url string"


@pytest.fixture
def company(spark):
    """Rows of the company feed from overrides of one good row."""
    good = {
        "company_id": "1", "name": "Acme", "description": "A maker.", "company_size": "3", "state": "NY",
        "country": "US", "city": "New York", "zip_code": "10001", "address": "1 Main St", "url": "https://a.example.com/x",
    }

    def make(*overrides):
        rows = [(i, *{**good, **o}.values()) for i, o in enumerate(overrides)]
        return spark.createDataFrame(rows, "_seq bigint, " + COMPANY)

    return make
