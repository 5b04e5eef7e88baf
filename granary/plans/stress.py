"""Failure scenarios: small runs over a backend that misbehaves, held to what must be true whatever it does."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.operators import generate
from granary.plans.pipeline import Pipeline
from granary.plans.spec import compile_spec


@dataclass
class FaultyBackend:
    """Replies of ``inner`` but for every ``every``-th prompt (by its hash, so the same on any task), which fails by ``mode``:
    garbage, empty, truncate, raise (a lasting error) or busy (an error that a second call does not meet)."""

    mode: str
    every: int = 3
    inner: generate.MockBackend = field(default_factory=generate.MockBackend)
    asked: dict = field(default_factory=dict)

    def call(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> tuple[str, int, int]:
        hit = sum(prompt.encode()) % self.every == 0
        self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if hit and self.mode == "raise":
            raise generate.BackendError("refused", 400)
        if hit and self.mode == "busy" and self.asked[prompt] == 1:
            raise generate.BackendError("busy", 503)
        text, i, o = self.inner.call(prompt, max_tokens, temperature)
        if hit and self.mode == "garbage":
            text = "Sorry, here is no record."
        if hit and self.mode == "empty":
            text = ""
        if hit and self.mode == "truncate":
            text = text[: len(text) // 2]
        return text, i, o


MODES = ("garbage", "empty", "truncate", "raise", "busy")


def scenario(spark: SparkSession, root: str, mode: str, size: int = 8) -> list[str]:
    """What a run over a backend of this mode breaks; nothing, if all is well."""
    spec = compile_spec({"task": {"name": f"stress-{mode}"}, "axes": {"k": {"values": ["a", "b"]}}, "budget": {"target_size": size, "repair_tries": 1}})

    def reply(prompt: str, rng) -> dict:
        return {"text": " ".join(rng.choice(["river", "stone", "cloud", "field", "house", "light", "paper", "green"]) + str(rng.randrange(100)) for _ in range(14))}

    p = Pipeline(spark, f"{root}/{mode}", spec, FaultyBackend(mode, inner=generate.MockBackend(reply)))
    end = p.run("r", max_rounds=3)
    accepted, drops = p.accepted("r"), p.drops("r")
    problems = []
    if accepted.select("slot").unionByName(drops.select("slot")).groupBy("slot").count().filter("count > 1").count():
        problems.append("a slot is settled twice")
    if accepted.filter(F.coalesce(F.trim("text"), F.lit("")) == "").count():
        problems.append("a record without text was accepted")
    if accepted.groupBy("cell_id").count().join(p.plan(), "cell_id").filter("count > quota").count():
        problems.append("a cell holds more than its quota")
    if end == "complete" and accepted.count() != size:
        problems.append("complete, but not full")
    if mode == "busy" and drops.filter(F.array_contains("codes", "generate")).count():
        problems.append("an error that passes was not tried again")
    if mode == "raise" and end != "complete" and not drops.filter("layer = 'generate'").count():
        problems.append("lasting errors left no trace")
    before = accepted.count()
    if p.run("r", max_rounds=3) not in ("complete", "max_rounds", "stalled") or p.accepted("r").count() < before:
        problems.append("resuming lost records")
    return problems


def all_scenarios(spark: SparkSession, root: str) -> dict[str, list[str]]:
    return {m: scenario(spark, root, m) for m in MODES}


def as_json(found: dict[str, list[str]]) -> str:
    return json.dumps(found, indent=1, sort_keys=True)
