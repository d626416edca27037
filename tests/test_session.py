"""The shared-folder rule: use the session's checkpoint folder; a local
session without one gets a private folder; nothing fails either way."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
from regilens.session import checkpoint_root
from regilens.plans.catalog import run
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
root = checkpoint_root(spark)
assert root and "regilens-ckpt-" in root, root
assert checkpoint_root(spark) == root
print("rows", run(spark, "/root/testdata/sf0.001", "e04_total_dogs").first()[0])
"""


def test_local_session_without_checkpoint_dir():
    empty_conf = tempfile.mkdtemp(prefix="regilens-noconf-")
    env = {**os.environ, "SPARK_CONF_DIR": empty_conf}
    out = subprocess.run([sys.executable, "-c", SCRIPT % ROOT], env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 150" in out.stdout


def test_session_folder_is_used_when_set(spark):
    from regilens.session import checkpoint_root

    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = checkpoint_root(spark)
    if configured:
        assert root == configured
    else:
        assert root == spark.sparkContext.getCheckpointDir()


def test_stage_marker_check_on_uri_paths(spark):
    from regilens.plans.star import _complete
    from regilens.session import path_join

    d = tempfile.mkdtemp(prefix="regilens-uri-")
    uri = "file://" + d
    assert path_join(uri, "t") == uri + "/t"
    assert not _complete(spark, path_join(uri, "t"))
    spark.range(3).write.parquet(path_join(uri, "t"))
    assert _complete(spark, path_join(uri, "t"))
    assert _complete(spark, os.path.join(d, "t"))


def test_marker_and_folders_without_authority(spark):
    """``file:/path`` (one slash) is found like any other path."""
    from regilens.plans.star import _complete, write_table
    d = tempfile.mkdtemp(prefix="regilens-uri-")
    path = f"file:{d}/t"
    assert not _complete(spark, path)
    assert write_table(spark, spark.range(3), path).count() == 3
    assert _complete(spark, path) and sorted(os.listdir(d)) == ["t"]
    assert write_table(spark, spark.range(9), path).count() == 3  # finished tables stay
