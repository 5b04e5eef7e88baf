"""Task specs: strict reading, versions, seed gates, hooks, approvals of plans."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import path_exists, read_file, write_file
from granary.sources.store import canonical_json


class SpecError(ValueError):
    """A spec that breaks its schema; the message names the path."""


#: Sections of a spec and their keys; ``None`` admits any keys.
SECTIONS: dict[str, set[str] | None] = {
    "task": {"name", "type", "description", "language", "generation_mode"},
    "axes": None,
    "balance": None,
    "fields": None,
    "roles": {"roles", "first_role", "alternating", "numbered_from"},
    "rules": None,
    "thresholds": None,
    "budget": {"candidates", "target_size", "attempts_per_quota", "repair_tries"},
    "governance": {"exceptions", "entity_deny", "entity_allow", "pii_patterns", "toxicity_exceptions"},
    "models": None,
    "rubric": {"verdict", "criteria", "reason_required", "examples"},
    "validation": {"layers", "consistency_k", "temperatures", "low_confidence"},
    "tools": None,
}
#: Sections that are lists; task types whose records are conversations; backends that decide but write no text.
LISTS = {"rules", "tools"}
CONVERSATIONS = {"classification_spans"}
DECIDERS = {"jev"}
#: What a judge may see of each task type.
JUDGE_FIELDS = {"classification_spans": {"messages"}, "sft_qa": {"question"}}
FIELD_TYPES = {"string", "integer", "number", "boolean", "array", "object", "null"}
#: Hooks and the number of positional arguments each takes.
HOOKS = {"label_rule": 1, "sampler_constraints": 2, "extra_validators": 1, "post_process": 1}


@dataclass(frozen=True)
class TaskSpec:
    body: dict
    version: str
    hooks: dict[str, Callable] = field(default_factory=dict)


def parse_spec(data: object) -> dict:
    """The spec as given, once it is known to hold only known sections and keys, and ``task.name``."""
    if not isinstance(data, dict):
        raise SpecError("spec: not an object")
    for section, value in data.items():
        if section not in SECTIONS:
            raise SpecError(f"{section}: unknown section")
        if not isinstance(value, list if section in LISTS else dict):
            raise SpecError(f"{section}: not {'a list' if section in LISTS else 'an object'}")
        known = SECTIONS[section]
        for key in set(value) - known if known is not None else ():
            raise SpecError(f"{section}.{key}: unknown key")
    if not data.get("task", {}).get("name"):
        raise SpecError("task.name: missing")
    for name, f in data.get("fields", {}).items():
        if f.get("type") not in FIELD_TYPES:
            raise SpecError(f"fields.{name}.type: {f.get('type')!r} is no type")
    return data


def read_spec(path: str) -> dict:
    """A JSON spec, or a YAML one where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise SpecError(f"{path}: no YAML reader is installed") from e
        return parse_spec(yaml.safe_load(text))
    return parse_spec(json.loads(text))


def spec_version(body: dict, hooks_source: str = "", seeds: bytes = b"") -> str:
    """sha256 over the length-prefixed canonical spec, hooks source and seeds: any change is another version."""
    h = hashlib.sha256()
    for part in (canonical_json(body).encode(), hooks_source.encode(), seeds):
        h.update(f"{len(part)}:".encode() + part)
    return h.hexdigest()


def check_hooks(hooks: dict[str, Callable]) -> list[str]:
    """Unknown hooks, and hooks that can't be called with their positional arguments."""
    problems = []
    for name, f in hooks.items():
        if name not in HOOKS:
            problems.append(f"hooks.{name}: unknown")
            continue
        try:
            inspect.signature(f).bind(*[None] * HOOKS[name])
        except TypeError:
            problems.append(f"hooks.{name}: takes {HOOKS[name]} arguments")
    return problems


def compile_spec(data: object, hooks: dict[str, Callable] | None = None, hooks_source: str = "", seeds: bytes = b"") -> TaskSpec:
    body = parse_spec(data)
    if problems := check_hooks(hooks or {}):
        raise SpecError("; ".join(problems))
    return TaskSpec(body, spec_version(body, hooks_source, seeds), hooks or {})


def seed_problems(seeds: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """``id, scanner, rule, path`` of findings in seeds (id, path, text): personal data and toxic words, never the matched text."""
    from granary.operators import governance

    both = governance.scan_pii(seeds).unionByName(governance.scan_toxicity(seeds, exceptions))
    return both.select("id", "scanner", "rule", "path").distinct()


def stage0_problems(body: dict, seeds: DataFrame | None = None, tools: set[str] = frozenset()) -> list[str]:
    """All that keeps a spec from a run, gathered: seeds (id, path, text) and judge examples that hold personal data or toxic
    words, examples that show the judge more than it may see, unknown tools, conversations without a turn structure, unset
    thresholds, votes that would repeat each other, and models asked for what they can't give."""
    from granary.operators import governance
    from granary.operators.metrics import GATED, GOVERNANCE

    out = []
    try:
        profile = governance.merge_profile({("extra_pii_patterns" if k == "pii_patterns" else k): v for k, v in body.get("governance", {}).items()})
    except governance.ProfileError as e:
        profile = governance.Profile()
        out.append(f"governance: {e}")
    scanner = governance.Composite(*profile.scanner().scanners[:2])  # personal data and toxicity
    if seeds is not None:
        found = governance.scan(seeds, scanner).select("id", "scanner", "rule", "path").distinct().orderBy("id", "path", "rule")
        out += [f"seeds: seed {r['id']} fails {r['scanner']} scan: rule {r['rule']} at {r['path']}" for r in found.toLocalIterator()]
    task, validation, models, rubric = (body.get(k, {}) for k in ("task", "validation", "models", "rubric"))
    visible = JUDGE_FIELDS.get(task.get("type"))
    examples = rubric.get("examples", [])
    for i, e in enumerate(examples):
        if visible is not None and (extra := sorted(set(e.get("record", {})) - visible)):
            out.append(f"rubric.examples[{i}]: the judge may not see {extra}")
    if examples and seeds is not None:
        rows = [(i, path, text) for i, e in enumerate(examples) for path, text in _strings({"record": e.get("record", {}), "note": e.get("note")})]
        if rows:
            found = governance.scan(seeds.sparkSession.createDataFrame(rows, "id int, path string, text string"), scanner).select("id", "scanner", "rule", "path").distinct().orderBy("id", "path", "rule")
            out += [f"rubric.examples[{r['id']}] fails {r['scanner']} scan: rule {r['rule']} at {r['path']}" for r in found.collect()]
    out += [f"tools: {t['name']!r} is in no registry" for t in body.get("tools", []) if t["name"] not in tools]
    if task.get("type") in CONVERSATIONS and not body.get("roles"):
        out.append(f"roles: {task['type']} records are conversations: declare roles and first_role")
    limits = body.get("thresholds", {})
    out += [f"thresholds.{name}: not set" for name in GATED if name != GOVERNANCE and limits.get(name) is None]
    backend = lambda *stages: next((models[s].get("backend") for s in stages if models.get(s)), None)
    voter, k = backend("consistency_judge", "judge"), validation.get("consistency_k", 5)
    votes = "L6" in validation.get("layers", ())
    if votes and k > 1 and voter not in DECIDERS and not any(t > 0 for t in validation.get("temperatures", [0.7])):
        out.append(f"validation.temperatures: {k} votes at temperature 0 would repeat each other")
    out += [f"models.{s}: {backend(s)} writes no text" for s in ("generator", "expansion") if backend(s) in DECIDERS]
    if rubric.get("reason_required", "flagged") != "never" and backend("fallback_judge", "judge") in DECIDERS:
        out.append(f"models: {backend('fallback_judge', 'judge')} writes no reasons: give a fallback_judge, or require none")
    if votes and voter in DECIDERS:
        if task.get("generation_mode") == "answer_emergent":
            out.append(f"models: {voter} can't answer questions: give a consistency_judge")
        elif k > 1:
            out.append(f"models: {voter} always decides alike, so its {k} votes would repeat each other")
    return out


def _strings(value: object, path: str = "") -> list[tuple[str, str]]:
    """Paths and texts of a small document's strings, private keys left out."""
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, dict):
        return [x for k, v in value.items() if not str(k).startswith("_") for x in _strings(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in _strings(v, f"{path}[{i}]")]
    return []


def plan_digest(cells: DataFrame) -> str:
    """sha256 of a plan's cells in plan order; a plan is small."""
    rows = [[r["cell_id"], r["quota"]] for r in cells.orderBy("pos").select("cell_id", "quota").collect()]
    return hashlib.sha256(canonical_json(rows).encode()).hexdigest()


def approve_plan(cells: DataFrame, path: str, by: str) -> None:
    write_file(cells.sparkSession, path, canonical_json({"plan": plan_digest(cells), "by": by}))


def is_approved(cells: DataFrame, path: str) -> bool:
    """Whether exactly this plan was approved; a changed plan is not."""
    spark = cells.sparkSession
    return path_exists(spark, path) and json.loads(read_file(spark, path))["plan"] == plan_digest(cells)


# ---------------------------------------------------------------------------- judges


def judge_schema(rubric: dict) -> dict:
    """The closed JSON schema of a judge's output: verdict, scores, a confidence for each, and a reason as far as it is required."""
    criteria = {c["name"]: {"enum": c["values"]} if c.get("values") else {"type": "integer", "minimum": c["min"], "maximum": c["max"]} for c in rubric["criteria"]}
    names = ["verdict", *criteria]
    closed = lambda props: {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
    props = {"verdict": {"enum": rubric["verdict"]["values"]}, "scores": closed(criteria), "confidence": closed({n: {"type": "number", "minimum": 0.0, "maximum": 1.0} for n in names})}
    out = closed(props)
    if rubric.get("reason_required", "flagged") != "never":
        out["properties"] = props | {"reason": {"type": "string", "minLength": 1}}
        if rubric.get("reason_required") == "always":
            out["required"] = [*out["required"], "reason"]
    return out


def parse_judge(replies: DataFrame, rubric: dict, column: str = "reply") -> DataFrame:
    """Adds ``verdict, scores, confidence, parsed``: replies (JSON) that hold the rubric's fields and no others, with allowed
    verdicts and scores and confidences in [0, 1]; integers are strict, so true and 1.0 are none. Others have parsed false and nulls."""
    obj = lambda p: F.get_json_object(column, p)
    keys = lambda p: F.array_sort(F.coalesce(F.json_object_keys(obj(p)), F.array().cast("array<string>")))
    names = sorted(["verdict", *(c["name"] for c in rubric["criteria"])])
    allowed = {"verdict", "scores", "confidence"} | ({"reason"} if rubric.get("reason_required", "flagged") != "never" else set())
    ok = F.try_parse_json(column).isNotNull() & obj("$.verdict").isin(rubric["verdict"]["values"])
    ok = ok & (F.size(F.array_except(keys("$"), F.array(*[F.lit(a) for a in sorted(allowed)]))) == 0)
    ok = ok & (keys("$.scores") == F.array(*[F.lit(c["name"]) for c in sorted(rubric["criteria"], key=lambda c: c["name"])])) & (keys("$.confidence") == F.array(*[F.lit(n) for n in names]))
    for c in rubric["criteria"]:
        v = obj(f"$.scores['{c['name']}']")
        ok = ok & (v.isin(c["values"]) if c.get("values") else v.rlike(r"\A-?\d+\z") & F.expr(f"try_cast(get_json_object({column}, \"$.scores['{c['name']}']\") as bigint)").between(c["min"], c["max"]))
    for n in names:
        ok = ok & F.coalesce(F.expr(f"try_cast(get_json_object({column}, \"$.confidence['{n}']\") as double)").between(0.0, 1.0), F.lit(False))
    if rubric.get("reason_required") == "always":
        ok = ok & (F.length(obj("$.reason")) > 0)
    good = F.coalesce(ok, F.lit(False))
    return replies.select("*", F.when(good, obj("$.verdict")).alias("verdict"), F.when(good, F.from_json(obj("$.scores"), "map<string,string>")).alias("scores"), F.when(good, F.from_json(obj("$.confidence"), "map<string,double>")).alias("confidence"), good.alias("parsed"))
