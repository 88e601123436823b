import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("pixtab-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pixtab-test-"))
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Build a point table from ``{image: [(y, x), …]}``."""
    def build(images):
        rows = [(i, y, x) for i, pts in images.items() for y, x in pts]
        return spark.createDataFrame(rows, "image_id string, y int, x int")
    return build
