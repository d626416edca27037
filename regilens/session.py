"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry. AQE re-plans at each shuffle boundary:
# it coalesces small partitions, splits skewed join partitions, and turns a
# sort-merge join into a broadcast join when the *measured* size of a side is
# under the threshold, so no code path forces a broadcast by hand.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "regilens",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (``local[cores]``)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {**BASE_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": driver_memory, **(extra or {})}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# On a shared cluster also set, per workload:
#   spark.sql.adaptive.coalescePartitions.parallelismFirst=false
#   spark.sql.adaptive.advisoryPartitionSizeInBytes=128m..256m
#   spark.sql.shuffle.partitions  ~ (largest shuffle) / 200 MB
#   spark.sql.files.maxPartitionBytes=256m
# Locally the defaults (keep one task per core) parallelise better.


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). A local session without one gets a private folder (set
    through ``SparkContext.setCheckpointDir``; the conf key itself cannot
    change at run time); on a cluster an unset folder is an error, since the
    driver cannot guess one that all executors share."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="regilens-ckpt-"))
    return sc.getCheckpointDir()


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of any path Spark can open: with or without a scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])
