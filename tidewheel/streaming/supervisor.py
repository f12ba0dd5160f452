"""Restarts of a failed streaming query from its checkpoint, and views of its progress."""

from __future__ import annotations

import ast
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CREATED, RUNNING, FINISHED, FAILING, RESTARTING, FAILED, CANCELLED = "CREATED", "RUNNING", "FINISHED", "FAILING", "RESTARTING", "FAILED", "CANCELLED"

#: Columns of the views.
VIEWS = {
    "status": "name string, state string, restarts long, batches long, last_failure string",
    "checkpoints": "id long, rows long, duration_ms long",
    "metrics": "id long, records_in long, records_per_second double, busy_ms long, state_rows long, state_bytes long, late_rows long,"
    " deserialization_failures long, watermark string",
    "lag": "source string, partition string, position long, end long, lag long",
}


def has_checkpoint(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a query has completed a micro-batch under this checkpoint location."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and any(s.getPath().getName().isdigit() for s in fs.listStatus(path))


def _positions(offset: Any) -> dict[str, int]:
    """Positions by partition, of what a source says of itself: a number, or numbers in (nested) objects, also as text.

    Progress that has passed through Python holds the text of a dict, other progress JSON.
    """
    if isinstance(offset, str):
        try:
            offset = json.loads(offset)
        except json.JSONDecodeError:
            try:
                offset = ast.literal_eval(offset)
            except (ValueError, SyntaxError):
                return {}
    if isinstance(offset, bool) or offset is None:
        return {}
    if isinstance(offset, int):
        return {"": offset}
    if not isinstance(offset, dict):
        return {}
    return {f"{name}.{inner}".rstrip("."): n for name, part in offset.items() if not isinstance(part, str) for inner, n in _positions(part).items()}


@dataclass
class Job:
    """A query that is started again, from its checkpoint, up to so many times after failures.

    ``resumable`` tells whether there is something to go on from (``has_checkpoint``); where there isn't, a failure is final.
    The views can be read while the job runs in another thread.
    """

    name: str
    start: Callable[[], StreamingQuery]
    attempts: int = 3
    delay: float = 1.0
    resumable: Callable[[], bool] = lambda: True
    state: str = CREATED
    failures: list[str] = field(default_factory=list)
    query: StreamingQuery | None = None
    history: list[dict[str, Any]] = field(default_factory=list)

    def run(self) -> str:
        """Until the query ends by itself, is cancelled, or has failed for good."""
        while self.state != CANCELLED:
            self.state, self.query = RUNNING, None
            try:
                self.query = self.start()
                self.query.awaitTermination()
                self._ended()
                if self.state != CANCELLED:
                    self.state = FINISHED
                return self.state
            except Exception as e:
                self._ended()
                self.failures.append(str(e))
                if self.state == CANCELLED:
                    break
                self.state = FAILING
                if len(self.failures) > self.attempts or not self.resumable():
                    self.state = FAILED
                    return self.state
                self.state = RESTARTING
                time.sleep(self.delay)
        return self.state

    def cancel(self) -> bool:
        """False if the job has ended already."""
        if self.state in (FINISHED, FAILED, CANCELLED):
            return False
        self.state = CANCELLED
        if self.query is not None:
            self.query.stop()
        return True

    def _progress(self) -> list[dict[str, Any]]:
        query = self.query
        return [] if query is None else [dict(p) if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]

    def _ended(self) -> None:
        self.history += self._progress()
        self.query = None

    # -- views ---------------------------------------------------------------------------------------------

    def intervals(self) -> list[dict[str, Any]]:
        """The progress of every attempt, the running one included."""
        return self.history + self._progress()

    def status(self) -> dict[str, Any]:
        failures = self.failures
        return {
            "name": self.name, "state": self.state, "restarts": len(failures) - (self.state in (FAILING, FAILED)), "batches": len(self.intervals()),
            "last_failure": failures[-1] if failures else None,
        }

    def checkpoints(self) -> list[dict[str, Any]]:
        """Completed intervals: micro-batches."""
        return [{"id": p["batchId"], "rows": p["numInputRows"], "duration_ms": p.get("batchDuration")} for p in self.intervals()]

    def metrics(self) -> list[dict[str, Any]]:
        """Rows in, pace, state, rows behind the watermark, undecodable messages and watermark by interval."""
        out = []
        for p in self.intervals():
            states, observed = p.get("stateOperators", []), p.get("observedMetrics") or {}
            bad = [dict(x if isinstance(x, dict) else x.asDict()).get("deserialization_failures") for x in observed.values()]
            out.append({
                "id": p["batchId"], "records_in": p["numInputRows"], "records_per_second": p.get("processedRowsPerSecond"), "busy_ms": p.get("batchDuration"),
                "state_rows": sum(s.get("numRowsTotal", 0) for s in states), "state_bytes": sum(s.get("memoryUsedBytes", 0) for s in states),
                "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in states), "deserialization_failures": sum(n for n in bad if n),
                "watermark": p.get("eventTime", {}).get("watermark"),
            })
        return out

    def lag(self) -> list[dict[str, Any]]:
        """By source and partition: where the last interval ended, the latest position it saw, and what lies between."""
        out, seen = [], self.intervals()
        for s in seen[-1]["sources"] if seen else []:
            ends = _positions(s.get("latestOffset"))
            for partition, position in sorted(_positions(s.get("endOffset")).items()):
                end = ends.get(partition)
                out.append({"source": s["description"], "partition": partition, "position": position, "end": end, "lag": None if end is None else max(0, end - position)})
        return out

    def gauges(self) -> str:
        """The last interval's numbers in the text form that scrapers read; NaN where there is no sample yet."""
        last = (self.metrics() or [{}])[-1]
        label = json.dumps(self.name, ensure_ascii=False)
        mark = last.get("watermark")
        seconds = datetime.fromisoformat(mark).timestamp() if mark else None
        values = {
            "records_in": last.get("records_in"), "busy_milliseconds": last.get("busy_ms"), "state_rows": last.get("state_rows"),
            "state_size_bytes": last.get("state_bytes"), "late_rows": last.get("late_rows"), "deserialization_failures": last.get("deserialization_failures"),
            "current_watermark": None if seconds is None else round(seconds * 1000), "restarts": self.status()["restarts"],
        }
        out = [f"tidewheel_{k}{{job={label}}} {'NaN' if v is None else v}" for k, v in values.items()]
        for x in self.lag():
            where = f"source={json.dumps(x['source'], ensure_ascii=False)},partition={json.dumps(x['partition'])}"
            out.append(f"tidewheel_source_lag_records{{job={label},{where}}} {'NaN' if x['lag'] is None else x['lag']}")
        return "\n".join(out) + "\n"

    def view(self, spark: SparkSession, name: str) -> DataFrame:
        """A view as a DataFrame, as of now: status, checkpoints, metrics or lag."""
        rows = getattr(self, name)()
        names = [c.split()[0] for c in VIEWS[name].split(",")]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in (rows if isinstance(rows, list) else [rows])], VIEWS[name])
