"""Generation in waves: prompts as columns, a backend called by partition, validation, repair with feedback, ordered settling."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import arrow_map, cut

#: Status codes after which a call is tried again, and the waits in seconds.
RETRY_STATUS = {408, 409, 429, 500, 502, 503, 504, 529}
WAITS = (1.0, 2.0, 4.0)


class BackendError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass
class MockBackend:
    """Replies made from the prompt's hash: the same wherever and however often a call runs. ``broken`` is the share of replies that are no JSON."""

    reply: Callable[[str, random.Random], dict] | None = None
    broken: float = 0.0

    def call(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> tuple[str, int, int]:
        rng = random.Random(hashlib.sha256(prompt.encode()).digest())
        if rng.random() < self.broken:
            text = "no record"
        else:
            text = json.dumps(self.reply(prompt, rng) if self.reply else {"text": f"reply {rng.randrange(10**6)}"})
        return text, -(-len(prompt) // 4), -(-len(text) // 4)

    def decide(self, state: str, questions: dict[str, list[str]]) -> dict[str, dict[str, float]]:
        """A probability for each allowed answer of each question, from the hash of state and question."""
        out = {}
        for name, answers in questions.items():
            rng = random.Random(hashlib.sha256(f"{name}\n{state}".encode()).digest())
            w = [rng.random() for _ in answers]
            out[name] = {a: x / sum(w) for a, x in zip(answers, w)}
        return out


def with_retry(call: Callable[[], tuple], sleep: Callable[[float], None] = time.sleep) -> tuple:
    for wait in (*WAITS, None):
        try:
            return call()
        except BackendError as e:
            if wait is None or (e.status is not None and e.status not in RETRY_STATUS):
                raise
            sleep(wait)
    raise AssertionError


def build_prompt(prefix: str, cell: Column, feedback: Column | None = None) -> Column:
    """A constant prefix, the cell's section, and on repair the errors of the last try."""
    parts = [F.lit(prefix), cell]
    if feedback is not None:
        parts.append(F.when(feedback.isNotNull(), F.concat(F.lit("Fix these errors: "), feedback)))
    return F.concat_ws("\n\n", *parts)


def generate(slots: DataFrame, backend) -> DataFrame:
    """Adds ``reply, input_tokens, output_tokens, error`` to slots (slot, prompt): one backend per task, calls retried; a failed call is the error ``generate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for slot, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((slot, *with_retry(lambda p=prompt: backend.call(p)), None))
                except BackendError as e:
                    rows.append((slot, None, 0, 0, f"generate: {e}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["slot", "reply", "input_tokens", "output_tokens", "error"])

    made = arrow_map(slots.select(F.col("slot").cast("bigint"), "prompt"), run, "slot bigint, reply string, input_tokens bigint, output_tokens bigint, error string")
    return slots.join(made, "slot")


def merge(recipe: Column, model: Column) -> Column:
    """Fields of both maps, the recipe's over the model's, private ones (leading underscore) dropped."""
    keep = F.map_filter(model, lambda k, _: ~F.map_contains_key(recipe, k) & ~k.startswith("_"))
    return F.map_concat(keep, F.map_filter(recipe, lambda k, _: ~k.startswith("_")))


@dataclass
class Settled:
    accepted: DataFrame
    drops: DataFrame
    passes: int
    usage: dict[str, int] = field(default_factory=dict)

    def cost(self, price_in: float | None, price_out: float | None) -> float | None:
        """What the calls cost at prices per million tokens; None where a price is unknown."""
        if price_in is None or price_out is None:
            return None
        return (self.usage["input_tokens"] * price_in + self.usage["output_tokens"] * price_out) / 1e6


def run_wave(slots: DataFrame, backend, validate: Callable[[DataFrame], DataFrame], prefix: str, repair_tries: int = 2) -> Settled:
    """Generate, validate and repair one wave.

    ``slots``: slot, cell_id, cell (text of the prompt's section). ``validate`` adds outcome, layer and issues. Repairable
    failures go again with their codes as feedback, at most ``repair_tries`` times; a hard failure ends at once, and a failed
    call is the layer ``generate``. Each pass holds only rows still to be repaired and is checkpointed.
    """
    open_ = cut(slots.select("slot", "cell_id", "cell", F.lit(None).cast("string").alias("feedback"), F.array().cast("array<struct<layer:string,codes:array<string>>>").alias("history")))
    accepted = drops = None
    usage = {"calls": 0, "input_tokens": 0, "output_tokens": 0}
    passes = 0
    for attempt in range(repair_tries + 1):
        made = generate(open_.withColumn("prompt", build_prompt(prefix, F.col("cell"), F.col("feedback"))), backend)
        checked = validate(made)
        layer = F.when(F.col("error").isNotNull(), F.lit("generate")).otherwise(F.col("layer"))
        outcome = F.when(F.col("error").isNotNull(), F.lit("fail_repairable")).otherwise(F.col("outcome"))
        codes = F.when(F.col("error").isNotNull(), F.array(F.lit("generate"))).otherwise(F.transform("issues", lambda i: i["code"]))
        done = cut(checked.select("slot", "cell_id", "cell", "reply", "input_tokens", "output_tokens", outcome.alias("outcome"), layer.alias("layer"), codes.alias("codes"), "history"))
        u = done.agg(F.count(F.lit(1)), F.sum("input_tokens"), F.sum("output_tokens")).first()
        usage = {k: usage[k] + (v or 0) for k, v in zip(usage, u)}
        passes += 1
        ok = done.filter("outcome = 'pass'").select("slot", "cell_id", "reply", F.lit(attempt).alias("repair_count"), F.transform("history", lambda h: h["layer"]).alias("failed_layers"))
        failed = done.filter("outcome <> 'pass'").withColumn("history", F.concat("history", F.array(F.struct("layer", "codes"))))
        final = failed if attempt == repair_tries else failed.filter("outcome = 'fail_hard'")
        gone = final.select("slot", "cell_id", "layer", "codes", F.lit(attempt + 1).alias("attempts"), (F.col("outcome") == "fail_hard").alias("hard"), "history")
        accepted = ok if accepted is None else accepted.unionByName(ok)
        drops = gone if drops is None else drops.unionByName(gone)
        if attempt == repair_tries:
            break
        open_ = cut(failed.filter("outcome = 'fail_repairable'").select("slot", "cell_id", "cell", F.array_join("codes", ", ").alias("feedback"), "history"))
        if open_.isEmpty():
            break
    return Settled(accepted, drops, passes, usage)


def release_rounds(quotas: dict[str, int], run: Callable[[dict[str, int]], dict[str, int]], max_rounds: int = 3) -> tuple[dict[str, int], str]:
    """Run, then refill only short cells, until none is short, nothing more is accepted, or the rounds are over."""
    have: dict[str, int] = {}
    for _ in range(max_rounds):
        short = {c: q - have.get(c, 0) for c, q in quotas.items() if have.get(c, 0) < q}
        if not short:
            return have, "released"
        got = run(short)
        if not any(got.values()):
            return have, "stalled"
        for c, n in got.items():
            have[c] = have.get(c, 0) + n
    return have, "released" if all(have.get(c, 0) >= q for c, q in quotas.items()) else "max_rounds"


# ---------------------------------------------------------------------------- tools

#: Limits of the calculator: characters, exponent, size of a result.
LONGEST, LARGEST_EXPONENT, LARGEST = 200, 100, 1e18
_SYMBOL = re.compile(r"\s*(?:(\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()]))")
#: By operator: precedence, whether it groups from the right, and how many operands it takes.
_RANK = {"+": (1, False, 2), "-": (1, False, 2), "*": (2, False, 2), "/": (2, False, 2), "//": (2, False, 2), "%": (2, False, 2), "neg": (3, True, 1), "pos": (3, True, 1), "**": (4, True, 2)}


def _apply(op: str, stack: list) -> None:
    if len(stack) < _RANK[op][2]:
        raise ValueError("an operand is missing")
    b = stack.pop()
    if op in ("neg", "pos"):
        stack.append(-b if op == "neg" else b)
        return
    a = stack.pop()
    if op in ("/", "//", "%") and b == 0 or op == "**" and a == 0 and b < 0:
        raise ValueError("division by zero")
    if op == "**":
        if abs(b) > LARGEST_EXPONENT:
            raise ValueError(f"exponent {b} is too large")
        if a < 0 and b != int(b):
            raise ValueError("the result is no real number")
    try:
        out = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if op == "/" else a // b if op == "//" else a % b if op == "%" else a**b
    except OverflowError:
        raise ValueError("the result is too large") from None
    if not abs(out) <= LARGEST:  # NaN is caught as well
        raise ValueError("the result is too large")
    stack.append(out)


def calculate(expression: str) -> float | int:
    """Arithmetic on numbers with + - * / // % ** and parentheses, in the usual order; a sign binds less than a power to its
    right. Whole results are integers. Anything else raises ValueError, as do the limits above."""
    if len(expression) > LONGEST:
        raise ValueError(f"longer than {LONGEST} characters")
    values: list = []
    waiting: list[str] = []
    at, operand_next = 0, True
    text = expression.rstrip()
    while at < len(text):
        m = _SYMBOL.match(text, at)
        if m is None:
            raise ValueError(f"not arithmetic: {text[at:]!r}")
        at = m.end()
        number, op = m.groups()
        if number is not None or op == "(":
            if not operand_next:
                raise ValueError("an operator is missing")
            if number is None:
                waiting.append("(")
                continue
            try:
                values.append(int(number) if number.replace("_", "").isdigit() else float(number))
            except ValueError:
                raise ValueError(f"no number: {number!r}") from None
            operand_next = False
        elif op == ")":
            if operand_next:
                raise ValueError("an operand is missing")
            while waiting and waiting[-1] != "(":
                _apply(waiting.pop(), values)
            if not waiting:
                raise ValueError("a parenthesis is missing")
            waiting.pop()
        elif operand_next:
            if op not in "+-":
                raise ValueError("an operand is missing")
            waiting.append("neg" if op == "-" else "pos")
        else:
            rank, from_right, _ = _RANK[op]
            while waiting and waiting[-1] != "(" and (_RANK[waiting[-1]][0] > rank or _RANK[waiting[-1]][0] == rank and not from_right):
                _apply(waiting.pop(), values)
            waiting.append(op)
            operand_next = True
    if operand_next:
        raise ValueError("an operand is missing")
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("a parenthesis is missing")
        _apply(waiting.pop(), values)
    out = values.pop()
    return int(out) if isinstance(out, float) and out.is_integer() else out


class ToolError(ValueError):
    """A refused or failed tool call; ``code`` names why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: Types of tool arguments and what Python values have them; true and false are no numbers.
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def argument_problems(schema: dict, args: object, path: str = "arguments") -> list[str]:
    """What in ``args`` breaks a JSON schema of type, properties, required, additionalProperties, items, enum and bounds."""
    kind = schema.get("type")
    if kind and (not isinstance(args, _KINDS[kind]) or kind != "boolean" and isinstance(args, bool)):
        return [f"{path}: no {kind}"]
    out = []
    if "enum" in schema and args not in schema["enum"]:
        out.append(f"{path}: not one of {schema['enum']}")
    if isinstance(args, (int, float)) and not isinstance(args, bool):
        out += [f"{path}: out of bounds"] * (args < schema.get("minimum", args) or args > schema.get("maximum", args))
    if isinstance(args, str) and len(args) < schema.get("minLength", 0):
        out.append(f"{path}: too short")
    if isinstance(args, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in args]
        for k, v in args.items():
            if k in known:
                out += argument_problems(known[k], v, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(args, list) and "items" in schema:
        out += [p for i, v in enumerate(args) for p in argument_problems(schema["items"], v, f"{path}[{i}]")]
    return out


def cache_key(tool: str, args: object) -> str:
    """sha256 of the call: a JSON object of the tool and of its arguments as canonical JSON."""
    canonical = json.dumps(args, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(json.dumps({"tool": tool, "arguments": canonical}).encode()).hexdigest()


@dataclass
class Tool:
    call: Callable[[dict], object]
    schema: dict = field(default_factory=lambda: {"type": "object"})
    sensitivity: str = "public"


@dataclass
class ToolGateway:
    """Calls of allowed tools with checked arguments, within budgets; equal calls are answered from the cache. ``trace`` has
    every answered call, with the tool's sensitivity."""

    tools: dict[str, Tool]
    allowed: set[str]
    max_calls: int = 10
    max_tokens: int = 10_000
    calls: int = 0
    tokens: int = 0
    cache: dict[str, object] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def call(self, tool: str, args: dict) -> object:
        if tool not in self.allowed or tool not in self.tools:
            raise ToolError("tool_not_allowed", f"tool {tool} is not allowed")
        if self.calls >= self.max_calls or self.tokens >= self.max_tokens:
            raise ToolError("tool_budget", "the tool budget is spent")
        t = self.tools[tool]
        if problems := argument_problems(t.schema, args):
            raise ToolError("tool_arguments", "; ".join(problems))
        key = cache_key(tool, args)
        self.calls += 1
        cached = key in self.cache
        if not cached:
            try:
                self.cache[key] = t.call(args)
            except Exception as e:  # noqa: BLE001 - whatever a tool raises is its error
                raise ToolError("tool_failed", f"{tool}: {type(e).__name__}: {e}") from e
        result = self.cache[key]
        self.tokens += -(-len(json.dumps(result, ensure_ascii=False)) // 4)
        self.trace.append({"tool": tool, "arguments": args, "result": result, "sensitivity": t.sensitivity, "cached": cached})
        return result


def generate_with_tools(call: Callable[[list[dict]], dict], prompt: str, gateway: ToolGateway, max_steps: int = 8) -> dict:
    """One candidate of a model that may ask for tools: ``reply``, ``trace``, ``error`` (a code) and ``steps``.

    ``call`` answers a list of messages with {"text"} or {"tools": [{"name", "arguments"}]}. A refused or failed tool call
    is told to the model, which may go on; a spent budget, or ``max_steps`` without a text, ends the candidate."""
    said = [{"role": "user", "content": prompt}]
    for step in range(1, max_steps + 1):
        try:
            out = with_retry(lambda: call(said))
        except BackendError as e:
            return {"reply": None, "trace": gateway.trace, "error": "generate", "message": str(e), "steps": step}
        asked = out.get("tools") or []
        if not asked:
            return {"reply": out.get("text"), "trace": gateway.trace, "error": None, "message": None, "steps": step}
        said.append({"role": "assistant", "tools": asked})
        for t in asked:
            try:
                said.append({"role": "tool", "name": t["name"], "content": gateway.call(t["name"], t.get("arguments", {}))})
            except ToolError as e:
                if e.code == "tool_budget":
                    return {"reply": None, "trace": gateway.trace, "error": e.code, "message": str(e), "steps": step}
                said.append({"role": "tool", "name": t["name"], "error": e.code, "content": str(e)})
    return {"reply": None, "trace": gateway.trace, "error": "tool_steps", "message": f"no reply within {max_steps} steps", "steps": max_steps}


def expand_keywords(initial: list[str], ask: Callable[[str, list[str]], list[str]], cap: int) -> tuple[list[str], list[dict]]:
    """Keywords widened in both directions (prerequisite, advanced) in turn until the cap or until neither brings new ones; with the history."""
    found, history = list(dict.fromkeys(initial))[:cap], []
    while len(found) < cap:
        before = len(found)
        for way in ("prerequisite", "advanced"):
            new = [k for k in dict.fromkeys(ask(way, found)) if k not in found][: cap - len(found)]
            history.append({"direction": way, "added": new})
            found += new
        if len(found) == before:
            break
    return found, history
