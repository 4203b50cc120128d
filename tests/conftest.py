import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="palimpsest-test-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("palimpsest-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="palimpsest-test-", dir="/tmp")


@pytest.fixture()
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_all(**settings):
        for name, value in settings.items():
            key = "spark.sql." + name.replace("_", ".")
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def captures_of(spark, rows):
    """Captures from ``(scid, timestamp, url_origin, statuscode)``."""
    from palimpsest.sources import listing

    parsed = spark.createDataFrame(
        [(s, t, "D", "text/html", c, u, "ok", "") for s, t, u, c in rows],
        "line_no long, timestamp string, digest string, mimetype string, statuscode string, url_origin string, verdict string, line string",
    )
    return listing.to_captures(parsed)
