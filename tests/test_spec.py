import json

import pytest

from granary.operators import planning, retrieval
from granary.operators.metrics import GATED
from granary.plans import spec

RUBRIC = {"verdict": {"values": ["yes", "no"]}, "criteria": [{"name": "depth", "min": 1, "max": 5}, {"name": "tone", "values": ["calm", "rough"]}]}
GOOD = {"verdict": "yes", "scores": {"depth": 3, "tone": "calm"}, "confidence": {"verdict": 0.9, "depth": 1, "tone": 0.0}}


def test_unknown_keys_name_their_path():
    with pytest.raises(spec.SpecError, match="budget.tokens"):
        spec.parse_spec({"task": {"name": "x"}, "budget": {"tokens": 1}})
    with pytest.raises(spec.SpecError, match="extra"):
        spec.parse_spec({"task": {"name": "x"}, "extra": {}})
    with pytest.raises(spec.SpecError, match="fields.a.type"):
        spec.parse_spec({"task": {"name": "x"}, "fields": {"a": {"type": "text"}}})


def test_version_changes_with_every_part():
    body = {"task": {"name": "x"}}
    v = {spec.spec_version(body), spec.spec_version(body, "a"), spec.spec_version(body, "", b"a"), spec.spec_version({"task": {"name": "y"}})}
    assert len(v) == 4
    with pytest.raises(spec.SpecError):
        spec.compile_spec(body, {"label_rule": lambda: None})
    assert spec.compile_spec(body, {"label_rule": lambda r: None}).version == spec.spec_version(body)


def test_judge_output_is_strict(spark):
    bad = [{**GOOD, "verdict": "maybe"}, {**GOOD, "more": 1}, {**GOOD, "scores": {"depth": 9, "tone": "calm"}}, {**GOOD, "scores": {"depth": True, "tone": "calm"}}, {**GOOD, "scores": {"depth": 3}}, {**GOOD, "confidence": {**GOOD["confidence"], "tone": 1.5}}]
    rows = [json.dumps(x) for x in [GOOD, {**GOOD, "reason": "fine"}, *bad]] + ["no json", None]
    got = spec.parse_judge(spark.createDataFrame([(r,) for r in rows], "reply string"), RUBRIC).collect()
    assert [r["parsed"] for r in got] == [True, True] + [False] * 8
    assert got[0]["scores"] == {"depth": "3", "tone": "calm"} and got[0]["confidence"]["verdict"] == 0.9
    assert spec.judge_schema(RUBRIC)["additionalProperties"] is False


def test_seed_gate_and_plan_approval(spark, tmp_path):
    seeds = spark.createDataFrame([(1, "question", "mail a@b.example"), (2, "question", "you idiot"), (3, "question", "calm")], "id bigint, path string, text string")
    assert {(r["id"], r["scanner"]) for r in spec.seed_problems(seeds).collect()} == {(1, "pii"), (2, "toxicity")}
    cells = planning.apportion(planning.cross(spark, [planning.Axis("a", ["x", "y"])]), 5)
    path = str(tmp_path / "approval.json")
    assert not spec.is_approved(cells, path)
    spec.approve_plan(cells, path, "someone")
    assert spec.is_approved(cells, path)
    assert not spec.is_approved(planning.apportion(planning.cross(spark, [planning.Axis("a", ["x", "y"])]), 6), path)


def test_retrieval_loop(spark):
    docs = spark.createDataFrame([(1, "bond pricing and yield curve"), (2, "yield curve and duration"), (3, "cooking")], "id bigint, text string")
    index = retrieval.build_index(docs)
    words, history = retrieval.retrieve_and_extract(index, docs, "finance", ["bond_pricing"], lambda text, known: [w for w in text.split() if len(w) > 4], iterations=3, top=2)
    assert words[0] == "bond_pricing" and "yield" in words and history[0]["query"] == "finance bond pricing"
    assert len(set(words)) == len(words)


def test_stage_zero_gathers_all_problems(spark):
    body = spec.parse_spec({
        "task": {"name": "x", "type": "classification_spans", "generation_mode": "answer_emergent"}, "tools": [{"name": "calc"}, {"name": "none"}], "thresholds": {"fidelity_min": 0.9, "kappa_min": None},
        "rubric": {"verdict": {"values": ["a"]}, "criteria": [], "examples": [{"record": {"messages": [{"content": "mail a.b@mail.example.org"}], "label": "a"}, "note": "n"}]},
        "validation": {"layers": ["L6"], "consistency_k": 3, "temperatures": [0.0]}, "models": {"generator": {"backend": "jev"}, "judge": {"backend": "jev"}}, "governance": {"toxicity_exceptions": ["profanity"]},
    })
    seeds = spark.createDataFrame([(1, "messages[0].content", "you idiot"), (2, "messages[0].content", "fine")], "id int, path string, text string")
    found = spec.stage0_problems(body, seeds, {"calc"})
    for part in ("governance: ", "seed 1 fails toxicity scan: rule insult", "examples[0]: the judge may not see ['label']", "examples[0] fails pii scan: rule email at record.messages[0].content", "'none' is in no registry", "roles: ", "thresholds.kappa_min", "models.generator: jev writes no text", "writes no reasons", "can't answer questions"):
        assert any(part in p for p in found), part
    assert not any("seed 2" in p or "idiot" in p or "fidelity_min" in p or "temperature" in p for p in found)
    fine = {"task": {"name": "x"}, "thresholds": {k: 1.0 for k in GATED}, "validation": {"layers": ["L6"], "temperatures": [0.0]}}
    assert spec.stage0_problems(fine) == ["validation.temperatures: 5 votes at temperature 0 would repeat each other"]
    assert spec.stage0_problems(fine | {"validation": {"layers": ["L6"], "temperatures": [0.0, 0.7]}}) == []
