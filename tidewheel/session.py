"""Session settings that the library's results depend on, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Timestamps without zone are read as UTC, and stateful processors need a state store that keeps timers on disk.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a new local folder if all runs on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
