"""The folder that the driver and all executors see."""

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder of our own on a local master, which
    sees its own disk everywhere, and an error on a cluster, whose executors would not find one another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lorescope-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
