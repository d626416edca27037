import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from regilens.session import BASE_CONF

    ckpt = tempfile.mkdtemp(prefix="regilens-test-")
    b = (SparkSession.builder.master("local[*]").appName("regilens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not (s.sparkContext.getConf().get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(ckpt)  # only where the session has none
    yield s
    s.stop()
