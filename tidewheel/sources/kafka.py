"""A Kafka topic of JSON messages. The connector is a separate jar; without it, building the reader fails.

Positions are the query's checkpoint's, as Spark keeps them; no group id is used. What is said of positions here works
on the JSON that Spark writes for them ({"topic": {"0": 17}}), and needs no jar.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jsonl


class OffsetError(ValueError):
    """Positions that aren't the topic's."""


def offsets(text: str, topic: str) -> dict[int, int]:
    """Next positions by partition. Other topics, a topic that is missing, and what is no natural number are errors."""
    try:
        topics = json.loads(text)
    except json.JSONDecodeError as e:
        raise OffsetError(f"offsets aren't JSON: {e}") from e
    if not isinstance(topics, dict) or set(topics) != {topic}:
        raise OffsetError(f"offsets belong to {sorted(topics) if isinstance(topics, dict) else topics}, not to {topic!r}")
    if not isinstance(topics[topic], dict):
        raise OffsetError(f"offsets of {topic!r} aren't by partition")
    out = {}
    for partition, position in topics[topic].items():
        if not (partition.isascii() and partition.isdigit()) or type(position) is not int or position < 0:
            raise OffsetError(f"invalid offset {position!r} of partition {partition!r}")
        out[int(partition)] = position
    return dict(sorted(out.items()))


def checked_restart(saved: dict[int, int], partitions: list[int]) -> dict[int, int]:
    """Saved positions of the partitions there are; one that has none is an error, as its start would be a guess."""
    if missing := sorted(set(partitions) - set(saved)):
        raise OffsetError(f"no offset for partitions {missing}")
    return {p: saved[p] for p in sorted(partitions)}


def owned(partitions: list[int], subtask: int, parallelism: int) -> list[int]:
    """The partitions of a subtask: every so many-th."""
    if not 0 <= subtask < parallelism:
        raise ValueError(f"subtask {subtask} is none of {parallelism}")
    return [p for p in sorted(partitions) if p % parallelism == subtask]


def lag(end: dict[int, int], position: dict[int, int]) -> dict[int, int]:
    """Messages between the next position and the end, by partition; never negative, 0 where the end isn't known."""
    return {p: max(0, end.get(p, 0) - n) for p, n in sorted(position.items())}


def topic(
    spark: SparkSession,
    name: str,
    schema: str,
    *,
    servers: str = "localhost:9092",
    per_trigger: int | None = None,
    starting: str = "earliest",
    subtask: int = 0,
    parallelism: int = 1,
    partitions: list[int] | None = None,
) -> DataFrame:
    """Decoded messages; the malformed are dropped and counted (``jsonl.counted``, observation ``decoding``).

    ``starting`` is "earliest", or positions that are checked first. ``partitions`` are the topic's; with them, a subtask
    reads its own, and positions must name each.
    """
    own = None if partitions is None else owned(partitions, subtask, parallelism)
    if starting != "earliest":
        saved = offsets(starting, name)
        starting = json.dumps({name: checked_restart(saved, own if own is not None else list(saved))})
    if own is None and parallelism != 1:
        raise ValueError("a subtask of several needs the topic's partitions")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("failOnDataLoss", "true")
    reader = reader.option("startingOffsets", starting)
    reader = reader.option("subscribe", name) if own is None else reader.option("assign", json.dumps({name: own}))
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return jsonl.counted(reader.load().select(F.col("value").cast("string").alias("value")), schema)
