"""A replay source with a line cursor: each micro-batch reads the next lines of a file, and a restart goes on from there.

It exists for tests and demonstrations of event time, where one record a batch lets the watermark move record by
record; files for throughput are read by ``jsonl.replay_stream``. The driver reads the file, from the cursor on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from . import jsonl


def _local(path: str) -> str:
    return path.removeprefix("file://")


def slice_of(line: str, parallelism: int) -> int:
    """The subtask that a line belongs to: its string hash as a signed 32-bit number, modulo the parallelism."""
    units = np.frombuffer(line.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    powers = np.cumprod(np.append(np.uint32(1), np.full(len(units), 31, np.uint32)), dtype=np.uint32)[-2::-1] if len(units) else units
    return int(np.sum(units * powers, dtype=np.uint32).astype(np.int32)) % parallelism


class LineReader(SimpleDataSourceStreamReader):
    """The cursor holds the physical line, lines of other subtasks included, its byte, and whose cursor it is."""

    def __init__(self, path: str, step: int, subtask: int = 0, parallelism: int = 1):
        if step < 1 or not 0 <= subtask < parallelism:
            raise ValueError(f"step {step} must be at least 1, and subtask {subtask} one of {parallelism}")
        self.path, self.step, self.subtask, self.parallelism = path, step, subtask, parallelism
        self.owner = f"{path} {subtask}/{parallelism}"

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0, "owner": self.owner}

    def _placed(self, start: dict) -> tuple[int, int]:
        """The cursor's line and byte, once they are known to fit this file and subtask."""
        if start.get("owner", self.owner) != self.owner:
            raise ValueError(f"the cursor belongs to {start['owner']}, not to {self.owner}")
        line, byte = start["line"], start.get("byte")
        if line < 0:
            raise ValueError(f"the cursor {line} is negative")
        with open(_local(self.path), "rb") as f:
            if byte is None:
                passed = sum(1 for _ in islice(iter(f.readline, b""), line))
                if passed < line:
                    raise ValueError(f"{self.path} has {passed} lines, but the cursor is at {line}")
                byte = f.tell()
            elif byte > f.seek(0, 2):
                raise ValueError(f"{self.path} ends before byte {byte}, where the cursor is")
        return line, byte

    def _read(self, start: dict, stop: int) -> tuple[list[tuple], dict]:
        line, byte = self._placed(start)
        out = []
        with open(_local(self.path), "rb") as f:
            f.seek(byte)
            while line < stop and (raw := f.readline()):
                text = raw.rstrip(b"\r\n").decode()
                if text.strip() and slice_of(text, self.parallelism) == self.subtask:
                    out.append((line, text))
                line += 1
            return out, {"line": line, "byte": f.tell(), "owner": self.owner}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._read(start, start["line"] + self.step)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._read(start, end["line"])[0])

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """``format("lines")``: columns line (its number, from 0) and value. Options: path, step (lines in a batch), subtask, parallelism."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "line long, value string"

    def simpleStreamReader(self, schema) -> LineReader:
        option = self.options.get
        return LineReader(self.options["path"], int(option("step", "1")), int(option("subtask", "0")), int(option("parallelism", "1")))


def lines(spark: SparkSession, path: str, step: int = 1, subtask: int = 0, parallelism: int = 1) -> DataFrame:
    """A subtask's lines as a stream. Blank lines are skipped, and count as lines."""
    spark.dataSource.register(Lines)
    reader = spark.readStream.format("lines").option("path", path).option("step", step)
    return reader.option("subtask", subtask).option("parallelism", parallelism).load()


def records(rows: DataFrame, schema: str) -> DataFrame:
    """The lines' number and fields; a line that can't be decoded fails the query and is named."""
    names = [f.split()[0] for f in schema.split(",")]
    complaint = F.concat(F.lit("Malformed replay at line "), (F.col("line") + 1).cast("string"))
    checked = jsonl.parsed(rows, schema)
    whole = F.when(F.col("data").isNull(), F.raise_error(complaint).cast(checked.schema["data"].dataType)).otherwise(F.col("data"))
    return checked.select("line", whole.alias("data")).select("line", *(f"data.{n}" for n in names))
