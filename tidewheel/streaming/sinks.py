"""Sinks. A table whose rows appear by committed interval, exactly once; and the console.

A micro-batch's files are written to a place of their own, and become part of the table when a manifest with the
batch's id is put in place by a rename. A batch that is replayed finds its manifest and does nothing; files without a
manifest are orphans that no reader sees; an empty batch leaves neither file nor manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """Rows that don't fit the table: the message names the column."""


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """The table's columns. Unknown and missing required columns are errors now, nulls in required ones when written."""
    known = {f.name for f in schema}
    if extra := [c for c in df.columns if c not in known]:
        raise ContractError(f"unknown column {extra[0]}")
    out = []
    for f in schema:
        if f.name not in df.columns:
            if not f.nullable:
                raise ContractError(f"required column {f.name} is missing")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        same = df.schema[f.name].dataType.simpleString() == f.dataType.simpleString()
        own = F.col(f.name) if same else F.col(f.name).cast(f.dataType)  # a cast can't promise that an array holds no null
        if not f.nullable:
            own = F.when(own.isNull(), F.raise_error(F.lit(f"required column {f.name} is null")).cast(f.dataType.simpleString())).otherwise(own)
        out.append(own.alias(f.name))
    return df.select(*out)


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, files: int | None = None):
        """``files``: at most so many for each batch (1 gives one file for each interval, as a single writer does)."""
        self.spark, self.path, self.schema, self.files = spark, path.rstrip("/"), schema, files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/_manifests/{batch:020d}.json"

    def committed(self) -> dict[int, dict]:
        fs, folder = self._fs(f"{self.path}/_manifests")
        if not fs.exists(folder):
            return {}
        out = {}
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    out[int(name[:-5])] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return out

    def stage(self, df: DataFrame) -> tuple[str, int]:
        """Write rows where no reader looks: the place, and how many."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = conformed(df, self.schema)
        (rows.coalesce(self.files) if self.files else rows).write.parquet(place)
        return place, self.spark.read.parquet(place).count()

    def commit(self, batch: int, place: str, rows: int) -> bool:
        """Make staged rows visible under a batch's id; False if the batch is there already."""
        if batch in self.committed():
            return False
        fs, final = self._fs(self._manifest(batch))
        _, draft = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps({"place": place.removeprefix(self.path + "/"), "rows": rows}).encode()))
        stream.close()
        return bool(fs.rename(draft, final))

    def append(self, df: DataFrame, batch: int) -> bool:
        """For ``foreachBatch``. True if the batch was committed now."""
        if batch in self.committed() or df.isEmpty():
            return False
        return self.commit(batch, *self.stage(df))

    def read(self) -> DataFrame:
        places = [f"{self.path}/{m['place']}" for _, m in sorted(self.committed().items())]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def orphans(self) -> list[str]:
        fs, folder = self._fs(f"{self.path}/data")
        known = {m["place"].split("/")[-1] for m in self.committed().values()}
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in known) if fs.exists(folder) else []


def console(prefix: str, out=print):
    """A ``foreachBatch`` function that prints rows: at least once, and no more than a driver can hold by a batch."""

    def write(df: DataFrame, batch: int) -> None:
        for row in df.toLocalIterator():
            out(f"{prefix}{row}")

    return write
