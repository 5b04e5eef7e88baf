import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.operators import generate, planning
from granary.plans import pipeline, registry, stress, tracing
from granary.plans.spec import compile_spec
from granary.session import cut
from granary.sources import records, store
from granary.streaming import dedup


def test_seeds_and_logs(spark, tmp_path):
    good = tmp_path / "s.jsonl"
    good.write_text('{"a": 1}\n\n{"b": "x"}\n')
    assert records.read_seeds(spark, [str(good)]).count() == 2
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n[1]\n')
    with pytest.raises(records.SourceError, match="b.jsonl:2"):
        records.read_seeds(spark, [str(bad)])
    log = tmp_path / "l.jsonl"
    log.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert records.read_log(spark, str(log)).count() == 2
    assert records.read_log(spark, str(tmp_path / "none")).count() == 0
    log.write_text('{"a": 1}\nbroken\n')
    with pytest.raises(records.SourceError, match=":2"):
        records.read_log(spark, str(log))


def test_corpus_and_held_out(spark, tmp_path):
    long = "word " * 20
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"text": "", "content": long}), json.dumps(long), json.dumps({"webpage": "short"})]))
    (tmp_path / "b.json").write_text(json.dumps([{"text": long}, long]))
    (tmp_path / "c.txt").write_text("  " + long)
    got = {r["id"]: r["text"] for r in records.read_corpus(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.txt")]).collect()}
    assert set(got) == {"a.jsonl:1", "a.jsonl:2", "b.json:1", "b.json:2", "c.txt:1"} and set(got.values()) == {long.strip()}
    (tmp_path / "h.csv").write_text("q,z\n\"[{'content': 'one'}, {'Content': 'two'}]\",x\nplain,y\n")
    rows = records.read_held_out(spark, [str(tmp_path / "h.csv")], ["q"]).collect()
    assert [(r["item_key"], r["text"]) for r in rows] == [("h.csv:1", "one two"), ("h.csv:2", "plain")]


def test_stages_runs_and_release(spark, tmp_path):
    p = str(tmp_path / "x" / "s.json")
    assert store.stage(spark, p, "v1", lambda: {"n": 1}) == {"n": 1} == store.stage(spark, p, "v1", lambda: 1 / 0)
    with pytest.raises(records.SourceError):
        records.read_stage(spark, p, "v2")
    assert store.latest_run(spark, str(tmp_path)) is None
    store.open_run(spark, str(tmp_path), "r1")
    assert store.latest_run(spark, str(tmp_path)) == "r1"
    df = spark.createDataFrame([(k, f"t{k}") for k in range(200, 0, -1)], "id int, t string").repartition(7)
    none = spark.createDataFrame([], "metric string, reason string")
    out = store.write_release(df, df.select("id", F.lit("m").alias("model")), none, str(tmp_path), "v1", "id", {"card.md": "# card"})
    assert store.verify_release(spark, out) == []
    assert cli.main(["verify", out], spark) == 0
    n = 0
    for data in sorted(Path(out).glob("dataset/part-*")):
        prov = next(Path(out).glob(f"provenance/{data.name[:10]}*"))
        for line, p in zip(data.read_text().splitlines(), map(json.loads, prov.read_text().splitlines()), strict=True):
            n += 1
            assert json.loads(line)["id"] == p["index"] + 1 and p["provenance"] == {"model": "m"}
            assert p["record_sha256"] == "sha256:" + hashlib.sha256((line + "\n").encode()).hexdigest()
    assert n == 200
    next(Path(out).glob("dataset/part-*")).write_text("changed")
    assert len(store.verify_release(spark, out)) == 1
    for frame, version in ((none, "v1"), (spark.createDataFrame([("m", "below_min")], "metric string, reason string"), "v2"), (none, ".v3")):
        with pytest.raises(store.ReleaseError):
            store.write_release(df, df, frame, str(tmp_path), version, "id")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in "ab":
            (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"k": f"{name}{k}"}) + "\r\n" for k in range(1, 501)))
        rows = records.read_seeds(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
        assert rows.rdd.getNumPartitions() > 4
        assert {(r["file"][0] + str(r["n"])) == json.loads(r["value"])["k"] for r in rows.collect()} == {True}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tool_cache_keys(spark, tmp_path):
    log = tmp_path / "cache.jsonl"
    args = {"b": 1, "a": ["é", True]}
    key = hashlib.sha256(json.dumps({"tool": "t", "arguments": json.dumps(args, ensure_ascii=False, sort_keys=True, separators=(",", ":"))}).encode()).hexdigest()
    log.write_text(json.dumps({"key": key, "tool": "t", "arguments": args, "result": {"x": 1}}) + "\n")
    assert [(r["tool"], r["result"]) for r in records.read_tool_cache(spark, str(log)).collect()] == [("t", '{"x": 1}')]
    log.write_text(json.dumps({"key": key, "tool": "u", "arguments": args, "result": 1}) + "\n")
    with pytest.raises(records.SourceError, match=":1"):
        records.read_tool_cache(spark, str(log))


def test_canonical_rows_sort_nested_keys(spark):
    df = spark.sql("select 1 as b, named_struct('z', 1, 'a', map('y', 2, 'c', 3)) as a")
    assert df.select(store.canonical_row(df)).first()[0] == '{"a":{"a":{"c":3,"y":2},"z":1},"b":1}'


def test_provenance_is_attached_and_split(spark):
    df, prov = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(1, "m", 2)], "id int, model string, repair_count int")
    both = store.attach(df, prov, "id")
    assert both.columns == ["id", "t", "_provenance"]
    bare, back = store.split(both, "id")
    assert bare.collect() == df.collect() and back.collect() == prov.collect()
    with pytest.raises(store.ReleaseError):
        store.attach(both, prov, "id")
    with pytest.raises(store.ReleaseError):
        store.split(df, "id")


def test_record_hash_ignores_column_order_and_private_columns(spark):
    df = spark.createDataFrame([(1, "a", "x")], "b int, a string, _p string")
    one = df.select(store.record_hash(df)).first()[0]
    other = df.select("a", "_p", "b")
    assert one == other.select(store.record_hash(other)).first()[0]


def test_review_queue(spark):
    items = store.queue_items(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "n int, content string"))
    ids = {r["content"]: r["item_id"] for r in items.collect()}
    res = spark.createDataFrame([(ids["x"], "reject", None, 1), (ids["x"], "relabel", "true", 2)], "item_id string, action string, label string, n int")
    assert [r["content"] for r in store.pending(items, res).collect()] == ["y"]
    assert [(r["content"], r["label"]) for r in store.gold(items, res).collect()] == [("x", "true")]


def test_plan_cli_and_axes(spark, tmp_path, capsys):
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"axes": {"k": {"values": ["a", "b"]}, "bloom": {"source": "bloom"}}}))
    assert cli.main(["plan", str(spec), "--target", "25"], spark) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(rows) == 12 and sum(r["quota"] for r in rows) == 25 and rows[1]["cell_id"] == "a|Understand"
    assert cli.main(["nonsense"], spark) == 2
    assert cli.main(["query", "nothing", "x"], spark) == 2


def test_scheduler_budget_and_stall():
    s = planning.Scheduler({"a": 2, "b": 1}, budget=4, attempts_per_quota=1)
    wave = s.wave(10)
    assert wave == ["a", "b", "a"]
    for c in wave:
        s.settle(c, False)
    assert s.next_cell() is None  # every cell has used its attempts
    with pytest.raises(planning.SchedulerError):
        s.settle("a", True)


def test_rounds_retries_and_tools():
    have, why = generate.release_rounds({"a": 3}, lambda short: {c: 1 for c in short}, 5)
    assert (have, why) == ({"a": 3}, "released")
    assert generate.release_rounds({"a": 3}, lambda short: {}, 5)[1] == "stalled"
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise generate.BackendError("busy", 503)
        return ("ok",)

    assert generate.with_retry(flaky, lambda s: None) == ("ok",) and len(calls) == 3
    with pytest.raises(generate.BackendError):
        generate.with_retry(lambda: (_ for _ in ()).throw(generate.BackendError("no", 400)), lambda s: None)
    calc = generate.Tool(lambda a: generate.calculate(a["x"]), {"type": "object", "properties": {"x": {"type": "string", "minLength": 1}}, "required": ["x"], "additionalProperties": False}, "internal")
    g = generate.ToolGateway({"calc": calc}, {"calc"}, max_calls=3)
    assert g.call("calc", {"x": "1+1"}) == 2 == g.call("calc", {"x": "1+1"}) and g.trace[1]["cached"] and g.trace[0]["sensitivity"] == "internal"
    for args, code in (({}, "tool_arguments"), ({"x": 3}, "tool_arguments"), ({"x": "1", "y": 2}, "tool_arguments"), ({"x": "1/0"}, "tool_failed"), ({"x": "3"}, "tool_budget")):
        with pytest.raises(generate.ToolError) as e:
            g.call("calc", args)
        assert e.value.code == code
    steps = iter([{"tools": [{"name": "calc", "arguments": {"x": "2*3"}}, {"name": "none", "arguments": {}}]}, {"text": "six"}])
    done = generate.generate_with_tools(lambda said: next(steps), "p", generate.ToolGateway({"calc": calc}, {"calc"}))
    assert done["reply"] == "six" and done["error"] is None and len(done["trace"]) == 1 and done["steps"] == 2
    assert generate.generate_with_tools(lambda said: {"tools": [{"name": "x"}]}, "p", generate.ToolGateway({}, set()), 2)["error"] == "tool_steps"
    words, history = generate.expand_keywords(["a"], lambda way, found: [f"{way}{len(found)}"], 4)
    assert len(words) == 4 and history[0]["direction"] == "prerequisite"


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    text = "one two three four five six seven eight nine ten eleven twelve"
    (src / "a.json").write_text("\n".join(json.dumps({"id": i, "text": t}) for i, t in [(1, text), (2, text + "."), (3, "other words entirely here")]))
    q = dedup.start(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    (src / "b.json").write_text("\n".join(json.dumps({"id": i, "text": t}) for i, t in [(4, text + " thirteen"), (5, "a new sentence about nothing much")]))
    q = dedup.start(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3, 5}


def test_every_oracle_names_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 55


def test_prompt_and_merge(spark):
    df = spark.createDataFrame([({"a": "1", "_p": "x"}, {"a": "2", "b": "3"}, "cell", None)], "r map<string,string>, m map<string,string>, c string, f string")
    row = df.select(generate.merge(F.col("r"), F.col("m")).alias("x"), generate.build_prompt("P", F.col("c"), F.col("f")).alias("p")).first()
    assert row["x"] == {"a": "1", "b": "3"} and row["p"] == "P\n\ncell"


def test_run_resume_evaluate_release(spark, tmp_path):
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"task": {"name": "demo"}, "axes": {"k": {"values": ["a", "b"]}}, "budget": {"target_size": 6}, "thresholds": {"coverage_min_cell_fill": 0.9}}))
    root = str(tmp_path / "root")
    texts = " ".join(f"w{k}" for k in range(500)).split()
    backend = generate.MockBackend(lambda prompt, rng: {"text": " ".join(rng.choices(texts, k=20))}, broken=0.3)
    p = pipeline.Pipeline(spark, root, compile_spec(json.loads(spec.read_text())), backend)
    sink = tracing.RecordingSink()
    p.tracer = tracing.Tracer(sink)
    assert p.run("r1") == "complete" and p.accepted("r1").count() == 6 and sink.spans[0].name == "round 0"
    assert p.run("r1") == "complete" and p.accepted("r1").count() == 6
    report = cut(p.evaluate("r1"))
    whole = report.filter("is_total").first()
    assert whole["accepted"] == 6 and whole["fill"] == 1 and whole["candidates"] >= 6 and whole["governance_violations"] is None
    assert {(r["cell_id"], r["reason"]) for r in p.gate(report).collect()} == {(None, "governance"), ("a", "governance"), ("b", "governance")}
    clean = p.accepted("r1").select("cell_id", F.array().cast("array<string>").alias("codes"))
    out = p.release("r1", "v1", flags=clean)
    assert store.verify_release(spark, out) == [] and (Path(out) / "card.md").exists()
    assert cli.main(["release", str(spec), root], spark) == 1
    assert cli.main(["resume", str(spec), root], spark) == 0


@pytest.mark.parametrize("mode", ["garbage", "busy"])
def test_failure_scenarios(spark, tmp_path, mode, monkeypatch):
    monkeypatch.setattr(generate, "WAITS", (0.0, 0.0, 0.0))
    assert stress.scenario(spark, str(tmp_path), mode) == []


def test_tracing_never_breaks_and_hides_held_out():
    class Broken:
        def take(self, span):
            raise OSError("full")

    t = tracing.Tracer(Broken())
    with t.span("a"):
        pass
    assert t.failures == 1
    sink = tracing.RecordingSink()
    t = tracing.Tracer(sink, lambda v: tracing.scrubbed(v, ["secret item", "secret"]))
    with pytest.raises(KeyError), t.span("outer", inputs={"p": ["the secret item here"]}):
        with t.span("inner") as s:
            s.end({"r": "a secret"})
        raise KeyError("x")
    inner, outer = sink.spans
    assert inner.parent == outer.id and inner.outputs == {"r": "a [held out]"} and outer.inputs == {"p": ["the [held out] here"]} and outer.error.startswith("KeyError")


def test_decisions_that_say_nothing_new_are_no_second_ones(spark):
    items = store.queue_items(spark.createDataFrame([(1, "x")], "n int, content string"))
    i = items.first()["item_id"]
    frame = lambda rows: spark.createDataFrame(rows, "item_id string, action string, label string, n int")
    old = frame([(i, "accept", None, 1)])
    assert store.resolve(items, old, frame([(i, "accept", None, 2)])).count() == 1
    assert store.resolve(items, old, frame([(i, "reject", None, 2)])).count() == 2
    for bad in ((i, "relabel", None, 2), (i, "maybe", None, 2), ("none", "accept", None, 2)):
        with pytest.raises(ValueError):
            store.resolve(items, old, frame([bad]))
