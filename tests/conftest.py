import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master("local[4]").appName("couplemap-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    sc = s.sparkContext
    # tests set their own checkpoint folder only where the session has none
    if not sc.getCheckpointDir() and not sc.getConf().get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="couplemap-test-ckpt-"))
    from couplemap.session import ship_package
    ship_package(s)  # workers import the package whatever the working folder
    yield s
    s.stop()
