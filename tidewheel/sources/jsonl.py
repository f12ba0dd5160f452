"""JSON Lines: declared schemas, and a policy for lines that can't be decoded.

Messages of a log are decoded and the malformed are dropped, and can be counted; a replayed file fails on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import string_hash
from ..session import shared_dir

_CORRUPT = "_corrupt_record"


def parsed(rows: DataFrame, schema: str, *, value: str = "value") -> DataFrame:
    """The rows with ``data`` (null where the value is no JSON object of the schema)."""
    data = F.from_json(F.col(value), f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return rows.withColumn("_data", data).withColumn("data", F.when(F.col("_data").isNotNull() & F.col(f"_data.{_CORRUPT}").isNull(), F.col("_data"))).drop("_data")


def decoded(rows: DataFrame, schema: str, *, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Decoded messages; the malformed, the literal null and null values are dropped. Unknown fields are ignored."""
    names = [f.split()[0] for f in schema.split(",")]
    return parsed(rows, schema, value=value).where("data is not null").select(*(keep or []), *(f"data.{n}" for n in names))


def counted(rows: DataFrame, schema: str, name: str = "decoding", *, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """As ``decoded``; the messages and those dropped are counted on the way, in a stream's progress by micro-batch.

    They are the metrics ``messages`` and ``deserialization_failures`` of the observation ``name``.
    """
    names = [f.split()[0] for f in schema.split(",")]
    seen = parsed(rows, schema, value=value).withColumn("_bad", F.col("data").isNull())
    seen = seen.observe(name, F.count("*").alias("messages"), F.count_if("_bad").alias("deserialization_failures"))
    return seen.where("not _bad").select(*(keep or []), *(f"data.{n}" for n in names))


def malformed_count(rows: DataFrame, schema: str, *, value: str = "value") -> DataFrame:
    return parsed(rows, schema, value=value).where("data is null").agg(F.count("*").alias("deserialization_failures"))


def written(rows: DataFrame, name: str) -> str:
    """Where the rows now lie as JSON Lines, in the shared folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.json(path)
    return path


def replayed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bounded replay. Blank lines are skipped; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replayed_slice(spark: SparkSession, path: str, schema: str, subtask: int, parallelism: int) -> DataFrame:
    """A subtask's part of a bounded replay: the lines whose string hash, signed, is its number modulo the parallelism."""
    if not 0 <= subtask < parallelism:
        raise ValueError(f"subtask {subtask} is none of {parallelism}")
    unsigned = string_hash(F.col("value"))
    signed = F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)
    own = spark.read.text(path).where((F.trim("value") != "") & (F.pmod(signed, F.lit(parallelism)) == subtask))
    names = [f.split()[0] for f in schema.split(",")]
    return own.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("data")).select(*(f"data.{n}" for n in names))


def replay_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The same as a stream: so many files in each micro-batch."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files).json(path)
