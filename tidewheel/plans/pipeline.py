"""Named pipelines over DataFrames: steps with ids, a parallelism and checks when the pipeline is built.

A step is a function of the DataFrames before it, so there are no cycles and a step's input is a step that exists; what
is left to check are ids, parallelism, keys, unreachable steps, and that rows come from somewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import exchange, transforms

MOST = 128


class InvalidPipeline(ValueError):
    """A pipeline that can't be built: the message names the step."""


@dataclass(eq=False)
class Step:
    """One named step; the methods add a step after it."""

    pipeline: Pipeline
    id: str
    make: Callable[..., DataFrame]
    inputs: list[Step]
    kind: str = "transform"
    width: int | None = None
    keys: list[str] = field(default_factory=list)

    def parallelism(self, n: int) -> Step:
        self.width = n
        return self

    def process(self, id: str, make: Callable[[DataFrame], DataFrame]) -> Step:
        return self.pipeline._add(Step(self.pipeline, id, make, [self]))

    def filter(self, id: str, condition: Column | str) -> Step:
        return self.process(id, lambda df: df.where(condition))

    def union(self, id: str, other: Step) -> Step:
        if other.pipeline is not self.pipeline:
            raise InvalidPipeline(f"{id}: {other.id} belongs to another pipeline")
        if other is self:
            raise InvalidPipeline(f"{id}: {self.id} can't be united with itself")
        return self.pipeline._add(Step(self.pipeline, id, lambda a, b: transforms.union_all(a, b), [self, other], width=self._most(other)))

    def _most(self, other: Step) -> int | None:
        widths = [x for x in (self.width, other.width) if x is not None]
        return max(widths) if widths else None

    def key_by(self, *keys: str) -> Keyed:
        if not keys:
            raise InvalidPipeline(f"{self.id}: a key needs a column")
        return Keyed(self, list(keys))

    def sink(self, id: str, write: Callable[[DataFrame], object]) -> Step:
        return self.pipeline._add(Step(self.pipeline, id, write, [self], kind="sink"))

    def with_event_time(self, make: Callable[[DataFrame], DataFrame]) -> Step:
        """Event time is a source's: later steps can't set it."""
        if self.kind != "source":
            raise InvalidPipeline(f"{self.id}: event time belongs to a source")
        inner = self.make
        self.make = lambda: make(inner())
        return self


@dataclass
class Keyed:
    """A step's rows by key: no step of its own."""

    step: Step
    keys: list[str]

    def process(self, id: str, make: Callable[[DataFrame], DataFrame]) -> Step:
        return self.step.pipeline._add(Step(self.step.pipeline, id, make, [self.step], keys=self.keys))

    def sink(self, id: str, write: Callable[[DataFrame], object]) -> Step:
        def keyed(df: DataFrame) -> object:
            return write(exchange.by_key(df, *self.keys))

        return self.step.pipeline._add(Step(self.step.pipeline, id, keyed, [self.step], kind="sink", keys=self.keys))


class Pipeline:
    def __init__(self, name: str, most: int = MOST):
        self.name, self.most, self.id, self.steps = name, most, uuid.uuid4().hex, []

    def source(self, id: str, make: Callable[[], DataFrame] | DataFrame) -> Step:
        return self._add(Step(self, id, (lambda: make) if isinstance(make, DataFrame) else make, [], kind="source"))

    def _add(self, step: Step) -> Step:
        self.steps.append(step)
        return step

    def build(self) -> Plan:
        if not self.steps:
            raise InvalidPipeline(f"{self.name}: no steps")
        if not 1 <= self.most <= MOST:
            raise InvalidPipeline(f"{self.name}: the greatest parallelism is from 1 to {MOST}, not {self.most}")
        seen: set[str] = set()
        for s in self.steps:
            if not s.id or s.id in seen:
                raise InvalidPipeline(f"{self.name}: two steps are called {s.id!r}" if s.id else f"{self.name}: a step has no id")
            seen.add(s.id)
            if s.width is not None and not 1 <= s.width <= self.most:
                raise InvalidPipeline(f"{s.id}: parallelism is from 1 to {self.most}, not {s.width}")
            for before in s.inputs:
                if before not in self.steps:
                    raise InvalidPipeline(f"{s.id}: its input {before.id} is not in the pipeline")
                if before.kind == "sink":
                    raise InvalidPipeline(f"{s.id}: nothing comes out of the sink {before.id}")
            if s.kind != "source" and not s.inputs:
                raise InvalidPipeline(f"{s.id}: it has no input")
        return Plan(self)


class Plan:
    """A checked pipeline."""

    def __init__(self, pipeline: Pipeline):
        self.name, self.steps = pipeline.name, list(pipeline.steps)
        self._made: dict[str, DataFrame] = {}

    def order(self) -> list[str]:
        """Ids, each after its inputs: a step can only be added after them."""
        return [s.id for s in self.steps]

    def downstream(self, id: str) -> list[str]:
        return [s.id for s in self.steps if any(b.id == id for b in s.inputs)]

    def sources(self) -> list[str]:
        return [s.id for s in self.steps if s.kind == "source"]

    def sinks(self) -> list[str]:
        return [s.id for s in self.steps if s.kind == "sink"]

    def frame(self, id: str) -> DataFrame:
        """A step's DataFrame, with all before it; steps with several readers are made once."""
        if id not in self._made:
            step = next(s for s in self.steps if s.id == id)
            out = step.make(*[self.frame(b.id) for b in step.inputs])
            widths = {b.width for b in step.inputs if b.width is not None}
            if step.kind == "transform" and step.width and widths and widths != {step.width}:
                out = out.repartition(step.width, *step.keys)
            self._made[id] = out
        return self._made[id]

    def run(self) -> dict[str, object]:
        """Every sink's result."""
        out = {}
        for s in self.steps:
            if s.kind == "sink":
                out[s.id] = s.make(*[self.frame(b.id) for b in s.inputs])
        return out
