"""Span trees of candidates: what a run did, told to a sink that can never break it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import write_file


@dataclass
class Span:
    name: str
    kind: str
    inputs: dict
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    parent: str | None = None
    began: float = field(default_factory=time.time)
    ended: float | None = None
    outputs: dict | None = None
    error: str | None = None

    def end(self, outputs: dict | None = None) -> None:
        self.outputs = outputs


class NullSink:
    def take(self, span: Span) -> None:
        pass


@dataclass
class RecordingSink:
    """Keeps spans in order of their ends, children before parents."""

    spans: list[Span] = field(default_factory=list)

    def take(self, span: Span) -> None:
        self.spans.append(span)


@dataclass
class FileSink:
    """Writes spans to a shared folder, ``flush_at`` of them a file, as JSON lines."""

    spark: SparkSession
    path: str
    flush_at: int = 1_000
    waiting: list[Span] = field(default_factory=list)

    def take(self, span: Span) -> None:
        self.waiting.append(span)
        if len(self.waiting) >= self.flush_at:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            write_file(self.spark, f"{self.path}/spans-{uuid.uuid4().hex}.jsonl", "".join(json.dumps(s.__dict__, sort_keys=True, default=str) + "\n" for s in self.waiting))
            self.waiting = []


def scrubbed(value: object, held_out: list[str], mark: str = "[held out]") -> object:
    """A value without held-out texts, at any depth; longer ones are taken out first."""
    if isinstance(value, str):
        for t in sorted(held_out, key=len, reverse=True):
            value = value.replace(t, mark) if t else value
        return value
    if isinstance(value, dict):
        return {k: scrubbed(v, held_out, mark) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [scrubbed(v, held_out, mark) for v in value]
    return value


class Tracer:
    """Nested spans; inputs and outputs pass ``scrub`` before a sink sees them. A sink that fails is counted and left alone."""

    def __init__(self, sink=None, scrub: Callable[[object], object] = lambda v: v):
        self.sink, self.scrub, self.failures = sink or NullSink(), scrub, 0
        self._open: list[Span] = []

    @contextmanager
    def span(self, name: str, kind: str = "chain", inputs: dict | None = None) -> Iterator[Span]:
        s = Span(name, kind, inputs or {}, parent=self._open[-1].id if self._open else None)
        self._open.append(s)
        try:
            yield s
        except BaseException as e:
            s.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self._open.pop()
            s.ended = time.time()
            try:
                s.inputs, s.outputs = self.scrub(s.inputs), self.scrub(s.outputs)
                self.sink.take(s)
            except Exception:  # noqa: BLE001 - tracing must not break what it watches
                self.failures += 1


def spans_of(settled: DataFrame) -> DataFrame:
    """``slot, step, name, outcome``: the steps of every candidate of a run (slot, history, outcome, layer), a row each, so that
    large runs are traced where their rows are and not on the driver."""
    tries = F.transform(F.coalesce("history", F.array().cast("array<struct<layer:string,codes:array<string>>>")), lambda h, i: F.struct(i.alias("step"), h["layer"].alias("name"), F.lit("fail").alias("outcome")))
    last = F.array(F.struct(F.size("history").alias("step"), F.coalesce("layer", F.lit("accepted")).alias("name"), F.col("outcome").alias("outcome")))
    return settled.select("slot", F.explode(F.when(F.col("outcome") == "pass", F.concat(tries, last)).otherwise(tries)).alias("s")).select("slot", "s.*")
