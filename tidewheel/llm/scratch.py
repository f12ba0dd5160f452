"""Intermediate tables in the folder that driver and executors share.

Stages are cut by writing a Parquet table there, so a lost executor costs a re-read and never a re-run of
the whole lineage. The folder is the session's ``spark.checkpoint.dir``; one is set only where none is.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """One operator run's tables. They live until the application ends, or until ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later stage reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # the JVM may be gone already
            return


def bounded_batches(spark: SparkSession, records: int = 2000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
