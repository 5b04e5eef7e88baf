import math
import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from granary.functions import scanners as S
from granary.functions import text as T
from granary.operators import diversity, generate, governance, judging, metrics, overlap, planning, retrieval, validate
from granary.session import numbered, shared_dir
from granary.streaming.dedup import settle_batch
from tests.test_text import py_norm, py_shingles

BASE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill at dawn"


def corpus(n=30, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randrange(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(rng.choices(vocab, k=rng.randrange(1, 40)))))
    return [*out, (n, ""), (n + 1, None), (n + 2, out[0][1].upper())]


def brute(rows, t=0.8):
    sets = {i: py_shingles(py_norm(x)) for i, x in rows if x and py_norm(x)}
    return {(a, b) for a in sets for b in sets if a < b and py_norm(dict(rows)[a]) != py_norm(dict(rows)[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > t}


def test_similarity_join_equals_brute_force(spark):
    rows = corpus()
    first = {}
    reps = [(i, x) for i, x in rows if x and py_norm(x) and first.setdefault(py_norm(x), i) == i]
    df = spark.createDataFrame(reps, "id bigint, text string")
    got = {(r["a"], r["b"]) for r in overlap.similarity_join(df).collect()}
    assert got == brute(reps)


def test_near_duplicates_one_row_per_record(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, text string, class_id string")  # a clashing column
    got = {r["id"]: r for r in overlap.near_duplicates(df).collect()}
    assert set(got) == {i for i, x in rows if x is not None}
    assert got[32]["class_id"] == 0
    assert overlap.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_similarity_join_over_blocks_and_widths(spark, monkeypatch, block):
    """Sketches of several widths, sizes of many texts in several blocks, blocks that meet and blocks that don't."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "COPIES", 40)
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = []
    for n in (1, 4, 20, 48, 70, 110, 200, 330):
        for _ in range(3):
            w = rng.choices(vocab, k=n)
            for k in range(6):  # a family around the threshold; words change place for place, so sizes are alike
                rows.append((len(rows), " ".join(rng.choice(vocab) if rng.random() < 0.015 * k else x for x in w[: n - n * k // 100])))
    first = {}
    reps = [(i, x) for i, x in rows if first.setdefault(x, i) == i]
    want = brute(reps)
    df = spark.createDataFrame(reps, "id bigint, text string")
    got = [(r["a"], r["b"]) for r in overlap.similarity_join(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 80
    named = df.select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("id"), "text")
    got = {(r["a"], r["b"]) for r in overlap.similarity_join(named).collect()}
    assert got == {(f"n{a:04}", f"n{b:04}") for a, b in want}


def test_near_duplicates_need_no_more_disk_than_texts(spark):
    """What is shuffled and staged stays in proportion to the texts, also where all of them are of the same words."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(100, 400))) for _ in range(600)]
    texts += [x + " end" for x in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")

    def written():
        at = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        folder = Path(urlparse(shared_dir(spark)).path)
        return sum(at.apply(i).totalShuffleWrite() for i in range(at.size())) + sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())

    before = written()
    got = {r["id"]: r["links"] for r in overlap.near_duplicates(df).collect()}
    assert {i for i, n in got.items() if n} == {*range(20), *range(600, 620)}
    assert written() - before < sum(map(len, texts))


def test_keep_first_equals_greedy(spark):
    rng = random.Random(3)
    edges = list({tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)})
    kept = set()
    for i in range(25):
        if not any((j, i) in edges for j in kept):
            kept.add(i)
    got = overlap.keep_first(spark.createDataFrame([(i,) for i in range(25)], "id bigint"), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["id"] for r in got.filter("kept").collect()} == kept


def test_best_match_ties_empty_and_limit(spark):
    items = spark.createDataFrame([(2, BASE), (1, BASE), (3, ""), (4, None)], "item_id bigint, text string")
    texts = spark.createDataFrame([(1, BASE), (2, ""), (3, None), (4, "zzz")], "id bigint, text string")
    assert [(r["id"], r["item_id"], r["score"]) for r in overlap.best_match(texts, items).collect()] == [(1, 1, 1.0)]
    layer = overlap.overlap_layer(texts, items, items.limit(0), limit=1.0).collect()
    assert [r["code"] for r in layer] == [None]  # equality passes


def test_stream_settling_equals_one_by_one(spark):
    rows = [(i, x) for i, x in corpus(20, 5) if x]
    pairs = brute(rows) | {(a, b) for a, x in rows for b, y in rows if a < b and py_norm(x) == py_norm(y)}
    kept = set()
    for i, _ in rows:
        if not any((j, i) in pairs for j in kept):
            kept.add(i)
    a = spark.createDataFrame(rows[:10], "id bigint, text string")
    b = spark.createDataFrame(rows[10:], "id bigint, text string")
    one = settle_batch(a, None)
    two = settle_batch(b, one)
    assert {r["id"] for r in one.collect()} | {r["id"] for r in two.collect()} == kept


def py_bleu(texts):
    toks = [t.split() for t in texts]
    total = []
    for i, h in enumerate(toks):
        refs = [t for j, t in enumerate(toks) if j != i]
        ps = []
        for n in range(1, 5):
            g = Counter(zip(*[h[k:] for k in range(n)]))
            if not g:
                continue
            best = Counter()
            for r in refs:
                best |= Counter(zip(*[r[k:] for k in range(n)]))
            hit = sum(min(c, best[x]) for x, c in g.items())
            ps.append(math.log((hit or 0.1) / sum(g.values())))
        ref = min((abs(len(r) - len(h)), len(r)) for r in refs)[1]
        total.append(math.exp(sum(ps) / len(ps) + (0 if len(h) >= ref else 1 - ref / len(h))))
    return sum(total) / len(total)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_self_bleu_equals_pairwise(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(1, 12))) for _ in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert abs(diversity.self_bleu(df).first()[0] - py_bleu(texts)) < 1e-9


def test_self_bleu_and_distinct_of_nothing_are_null(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id bigint, text string")
    assert diversity.self_bleu(df).first()[0] is None
    assert diversity.distinct_n(df.filter("id > 1"), 1).first()[0] is None
    assert diversity.distinct_n(spark.createDataFrame([("a b a b",)], "text string"), 2).first()[0] == 2 / 3


def test_bm25_formula(spark):
    docs = ["a b c", "a a d", "e f", ""]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(docs)), "id bigint, text string"))
    got = {r["id"]: r["score"] for r in retrieval.search(index, spark.createDataFrame([(1, "a d a")], "query_id bigint, text string")).collect()}
    n, av = 4, 8 / 4
    idf = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w, df in {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}.items()}
    s = lambda w, tf, dl: idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))
    assert set(got) == {0, 1}
    assert abs(got[1] - (2 * s("a", 2, 3) + s("d", 1, 3))) < 1e-9 and abs(got[0] - 2 * s("a", 1, 3)) < 1e-9


def test_majority_ties_and_abstentions(spark):
    rows = [(1, 0, "B"), (1, 1, "A"), (1, 2, None), (2, 0, None), (3, 0, "A"), (3, 1, "A"), (3, 2, "B")]
    got = {r["record_id"]: r for r in judging.majority(spark.createDataFrame(rows, "record_id bigint, ballot_no int, vote string")).collect()}
    assert (got[1]["value"], got[1]["votes"], got[1]["cast_votes"], got[1]["has_majority"]) == ("B", 1, 2, False)
    assert got[2]["value"] is None and got[2]["cast_votes"] == 0 and not got[2]["has_majority"]
    assert got[3]["has_majority"]


def test_kappa_undefined_for_one_label(spark):
    assert judging.kappa(spark.createDataFrame([("a", "a")] * 3, "judged string, human string")).first()["kappa"] is None
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    assert abs(judging.kappa(spark.createDataFrame(rows, "judged string, human string")).first()["kappa"] - 0.4) < 1e-12


def test_bins_keep_empty_and_ece(spark):
    df = spark.createDataFrame([(1.0, True), (0.95, False), (0.05, False), (None, True)], "confidence double, correct boolean")
    bins = {r["bin"]: r for r in judging.reliability_bins(df).collect()}
    assert len(bins) == 10 and bins[9]["n"] == 2 and bins[4]["confidence"] is None
    ece = judging.expected_calibration_error(judging.reliability_bins(df)).first()[0]
    assert abs(ece - (2 / 3 * abs(0.5 - 0.975) + 1 / 3 * 0.05)) < 1e-12


def test_apportion_and_fit(spark):
    cells = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.25), ("c", 2, 0.25)], "cell_id string, pos int, share double")
    assert [r["quota"] for r in planning.apportion(cells, 7).orderBy("pos").collect()] == [3, 2, 2]
    shares = planning.fit_shares([{"share": 1, "params": {"x": "1", "y": "1"}}, {"share": 1, "params": {"x": "1", "y": "2"}}, {"share": 2, "params": {"x": "2", "y": "1"}}], {"x": {"1": 0.5, "2": 0.5}})
    assert [round(s, 6) for s in shares] == [0.25, 0.25, 0.5]


def test_schedule_equals_greedy_machine(spark):
    quotas = {"a": 3, "b": 5, "c": 1, "d": 0}
    s = planning.Scheduler(quotas, budget=100)
    order = []
    while (c := s.next_cell()) is not None:
        order.append(c)
        s.settle(c, True)
    df = spark.createDataFrame([(c, k, q) for k, (c, q) in enumerate(quotas.items())], "cell_id string, pos int, quota bigint")
    assert [r["cell_id"] for r in planning.schedule(df).orderBy("slot").collect()] == order


def test_turns_spans_and_cascade(spark):
    m = "messages array<struct<turn:int,role:string,content:string>>, spans array<struct<turn:int,text:string,category:string>>, id int"
    rows = [([(1, "customer", "hello"), (2, "assistant", "hi")], [(1, "hell", "x")], 1), ([(1, "assistant", "a"), (3, "robot", None)], [(9, "q", "x"), (1, "zz", "x")], 2), (None, None, 3), ([], [], 4)]
    df = spark.createDataFrame(rows, m)
    t = {r["id"]: [i["code"] for i in r["i"]] for r in df.select("id", validate.turn_issues(F.col("messages"), ["customer", "assistant"]).alias("i")).collect()}
    assert t == {1: [], 2: ["first_role", "turn_numbering", "unknown_role"], 3: [], 4: []}
    sp = {r["id"]: [i["code"] for i in r["i"]] for r in df.select("id", validate.span_issues(F.col("messages"), F.col("spans")).alias("i")).collect()}
    assert sp == {1: [], 2: ["span_turn", "span_text"], 3: [], 4: []}
    c = validate.cascade(df, [("schema", validate.schema_issues(["messages"]), False), ("turns", validate.turn_issues(F.col("messages"), ["customer", "assistant"]), True)])
    assert {r["id"]: (r["outcome"], r["layer"]) for r in c.collect()} == {1: ("pass", None), 2: ("fail_hard", "turns"), 3: ("fail_repairable", "schema"), 4: ("pass", None)}


def test_tries_and_gate(spark):
    acc = spark.createDataFrame([("c", 1, [(0, "L2")]), ("c", 0, None)], "cell_id string, repair_count int, failed array<struct<attempt:int,layer:string>>")
    drops = spark.createDataFrame([("c", "L3", 2, None), ("d", "L1", 1, [("L1", ["x"])])], "cell_id string, layer string, attempts int, history array<struct<layer:string,codes:array<string>>>")
    got = sorted((r["cell_id"], r["layer"] or "") for r in metrics.tries(acc, drops).collect())
    assert got == [("c", ""), ("c", ""), ("c", "L2"), ("c", "L3"), ("c", "L3"), ("d", "L1")]
    v = spark.createDataFrame([(None, "fidelity_min", 0.95), (None, "governance_violations_max", 0.0), ("c", "overlap_max", 0.9), ("c", "governance_violations_max", 1.0)], "cell_id string, metric string, value double")
    bad = {(r["cell_id"], r["metric"]): r["reason"] for r in metrics.gate(v, {"fidelity_min": 0.95, "kappa_min": 0.7, "overlap_max": 0.8}).collect()}
    assert bad == {(None, "kappa_min"): "not_measured", (None, "overlap_max"): "not_measured", ("c", "overlap_max"): "above_max", ("c", "governance_violations_max"): "governance"}
    with pytest.raises(ValueError):
        metrics.gate(v, {}, ("governance_violations_max",))


def test_entities_and_identifiers(spark):
    df = spark.createDataFrame([(1, "p", "Acme  Bank is not Acme Bank Holdings; ref 123 456 7 and 0412 345 678")], "id bigint, path string, text string")
    assert [(r["start"], r["rule"]) for r in governance.scan_entities(df, ["Acme Bank"], ["Acme Bank Holdings"]).collect()] == [(0, "acme bank")]
    assert [r["matched"] for r in governance.sensitive_identifiers(df).collect()] == ["123 456 7"]
    tr = spark.createDataFrame([(1, "t", "secret", "ACME bank"), (1, "t", "public", "Holdings"), (1, "t", "secret", "abc")], "id bigint, tool string, sensitivity string, value string")
    assert governance.tool_leaks(df, tr).count() == 1


def test_wave_with_repairs(spark):
    backend = generate.MockBackend(reply=lambda p, rng: {"text": "good" if "Fix" in p else "bad"})
    slots = spark.createDataFrame([(i, "c", f"cell {i}") for i in range(6)], "slot bigint, cell_id string, cell string")

    def check(df):
        bad = F.get_json_object("reply", "$.text") != "good"
        return validate.cascade(df, [("L2", validate.issue(bad, "label_rule", "text"), False)])

    out = generate.run_wave(slots, backend, check, "Write a record.", repair_tries=1)
    assert out.passes == 2 and out.accepted.count() == 6 and out.drops.count() == 0
    assert out.usage["calls"] == 12
    assert generate.calculate("2*(3+4)") == 14 and generate.calculate("7/2") == 3.5
    with pytest.raises(ValueError):
        generate.calculate("__import__('os')")


# ---------------------------------------------------------------------------- cascade


def test_json_schema_over_nested_columns(spark):
    schema = {
        "required": ["q", "tags", "absent"],
        "properties": {
            "q": {"type": "string", "minLength": 2, "pattern": r"^\w"},
            "n": {"type": "integer", "minimum": 1, "maximum": 5},
            "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "enum": ["a", "b"]}},
            "m": {"type": "array", "items": {"type": "object", "required": ["role"], "properties": {"role": {"type": "string", "maxLength": 3}}}},
            "wrong": {"type": "boolean"},
        },
    }
    df = spark.createDataFrame([(1, "éa", 3, ["a"], [("x",)], None), (2, "!", 9, ["a", "z", "b"], [(None,), ("long",)], "t"), (3, None, None, None, None, None)], "id int, q string, n int, tags array<string>, m array<struct<role:string>>, wrong string")
    got = {r["id"]: [(i["code"], i["path"]) for i in r["i"]] for r in df.select("id", validate.json_schema_issues(schema, df.schema).alias("i")).collect()}
    assert got[1] == [("schema_required", "absent")]
    assert set(got[2]) == {("schema_required", "absent"), ("schema_minLength", "q"), ("schema_pattern", "q"), ("schema_maximum", "n"), ("schema_maxItems", "tags"), ("schema_enum", "tags[1]"), ("schema_required", "m[0].role"), ("schema_maxLength", "m[1].role"), ("schema_type", "wrong")}
    assert got[3] == [("schema_required", "absent"), ("schema_required", "q"), ("schema_required", "tags")]


def test_rules_labels_and_validators(spark):
    df = spark.createDataFrame([(1, [("customer", "Buy NOW"), ("assistant", "you should buy")], "true", "x"), (2, [("customer", "nowhere"), ("assistant", None)], "1", None), (3, None, None, "now")], "id int, messages array<struct<role:string,content:string>>, label string, note string")
    rule = {"kind": "forbidden", "keywords": ["now", "should"], "match": "word", "fields": ["note"]}
    need = {"kind": "required", "keywords": ["buy", "sell"], "require": "all", "roles": ["assistant"], "when": {"label": ["true", "1"]}}
    rows = df.select("id", validate.rule_issues(rule, F.col("messages")).alias("a"), validate.rule_issues(need, F.col("messages")).alias("b"), validate.label_issues(F.col("label"), F.when(F.col("id") < 3, "true")).alias("c")).collect()
    pick = lambda k: {r["id"]: [(i["code"], i["path"]) for i in r[k]] for r in rows}
    assert pick("a") == {1: [("keyword_forbidden", "messages[0].content"), ("keyword_forbidden", "messages[1].content")], 2: [], 3: [("keyword_forbidden", "note")]}
    assert pick("b") == {1: [("keyword_required", None)], 2: [("keyword_required", None)] * 2, 3: []}
    assert pick("c") == {1: [], 2: [("label_disagrees", "label")], 3: [("label_rule_error", "label")]}

    def validator(r):
        return ["short"] if len(r["note"]) < 2 else [("too_soon", "note")]

    got = {r["id"]: [(i["code"], i["path"]) for i in r["issues"]] for r in validate.extra_issues(df, validator, "id").collect()}
    assert got == {1: [("extra_validator", None)], 2: [("extra_validator_error", None)], 3: [("too_soon", "note")]}


def test_six_layers_end_at_the_first_that_objects(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, "", "a", True), (2, "bad " + words, "a", True), (3, "you idiot " + words, "a", True), (4, words, "a", True), (5, "five " * 9, "b", True), (6, "six " * 9, "a", True), (7, "seven " * 9, "a", True), (8, "eight " * 9, "a", False), (9, "nine " * 9, None, True)]
    df = spark.createDataFrame(rows, "id int, text string, label string, hard boolean")
    seen = []

    def watch(name, check):
        def run(reach):
            seen.append((name, {r["id"] for r in reach.collect()}))
            return check(reach)
        return run

    held = spark.createDataFrame([(1, words)], "item_id int, text string")
    judged = spark.createDataFrame([(5, "a", "b", 0.9), (6, "a", "a", 0.9), (7, "a", "a", 0.2), (8, "a", "a", 0.9), (9, None, "a", 0.9)], "id int, verdict string, label string, confidence double")
    votes = spark.createDataFrame([(6, "consistency_no_votes"), (7, "consistency_no_majority"), (8, "consistency_no_majority")], "id int, code string")
    scanner = governance.RuleScanner("toxicity", {"insult": S.toxicity_pattern("insult")})
    layers = [
        validate.Layer("L1", validate.json_schema_issues({"properties": {"text": {"minLength": 1}}}, df.schema)), validate.Layer("L2", validate.rule_issues({"kind": "forbidden", "keywords": ["bad"], "fields": ["text"]})),
        validate.Layer("L3", validate.governance_issues(F.array(F.struct(F.col("text").alias("content"))), scanner)), validate.Layer("L4", watch("L4", validate.overlap_issues(held))),
        validate.Layer("L5", watch("L5", validate.judge_issues(judged))), validate.Layer("L6", watch("L6", validate.vote_issues(votes, F.col("hard")))),
    ]
    got = {r["id"]: (r["layer"], r["outcome"], [i["code"] for i in r["issues"]]) for r in validate.run_cascade(df, layers).collect()}
    assert got == {
        1: ("L1", "fail_repairable", ["schema_minLength"]), 2: ("L2", "fail_repairable", ["keyword_forbidden"]), 3: ("L3", "fail_hard", ["toxicity_insult"]), 4: ("L4", "fail_hard", ["held_out_overlap"]), 5: ("L5", "fail_repairable", ["judge_disagrees"]),
        6: ("L6", "fail_hard", ["consistency_no_votes"]), 7: ("L6", "fail_repairable", ["consistency_no_majority"]), 8: (None, "pass", []), 9: ("L5", "fail_hard", ["judge_error"]),
    }
    assert seen == [("L4", {4, 5, 6, 7, 8, 9}), ("L5", {5, 6, 7, 8, 9}), ("L6", {6, 7, 8})]
    low = validate.run_cascade(df, [validate.Layer("L5", validate.judge_issues(judged, review=True))]).filter("id in (7, 9)").collect()
    assert {(r["id"], r["outcome"], r["issues"][0]["code"]) for r in low} == {(7, "fail_hard", "sent_to_review"), (9, "fail_hard", "sent_to_review")}
    trusted = validate.run_cascade(df, [validate.Layer("L6", validate.vote_issues(votes, trusted=df.filter("id = 7")))]).filter("id = 7").first()
    assert trusted["outcome"] == "pass"
    for names in (["L2", "L1"], ["L1", "L1"], ["L9"]):
        with pytest.raises(validate.CascadeError):
            validate.run_cascade(df, [validate.Layer(n, validate.no_issues()) for n in names])


def test_answers_and_options_of_a_task_type(spark):
    q = "Which?\nA) one\nB) two"
    df = spark.createDataFrame([(1, q, "Answer: B", "B"), (2, q, "Answer: B", "A"), (3, q, "none", None), (4, "Which?", "Answer: A", "A"), (5, q, "Answer: C", None), (6, None, None, None)], "id int, q string, r string, a string")
    got = {r["id"]: [i["code"] for i in r["i"]] for r in df.select("id", F.concat(validate.answer_issues(F.col("r"), F.col("a"), T.choice_answer), validate.option_issues(F.col("q"), F.col("r"), F.col("a"))).alias("i")).collect()}
    assert got == {1: [], 2: ["response_answer"], 3: ["response_answer"], 4: ["option"], 5: ["option"], 6: []}


# ---------------------------------------------------------------------------- report, plans, votes


def test_report_by_cell_and_overall(spark):
    L = "array<struct<layer:string,outcome:string,attempt:int>>"
    acc = spark.createDataFrame([
        (1, "a", "one two three", "x", 1, [("L2", "fail_repairable", 0), ("L5", "fail_repairable", 1), ("L5", "pass", 1)]), (2, "a", "one two four", "y", 0, [("L5", "fail_repairable", 0)]), (3, "b", "five six", None, 0, None)], f"id int, cell_id string, text string, label string, repair_count int, layer_results {L}")
    drops = spark.createDataFrame([("b", "L3", 2, None)], "cell_id string, layer string, attempts int, history array<struct<layer:string,codes:array<string>>>")
    cells = spark.createDataFrame([("a", 2, {"label": "x"}), ("b", 4, {"label": "y"}), ("c", 0, {"label": "y"})], "cell_id string, quota bigint, params map<string,string>")
    flags = spark.createDataFrame([("a", ["pii_email"]), ("a", []), ("b", None)], "cell_id string, codes array<string>")
    over = spark.createDataFrame([("a", "seed", 0.4), ("b", "held_out", 0.7), ("b", "corpus", 0.9)], "cell_id string, source string, score double")
    residuals = spark.createDataFrame([("x", 0.1)], "judged string, residual double")
    made = metrics.report(acc, drops, cells, residuals=residuals, fallback=0.3, kappa=0.8, flags=flags, overlaps=over, usage={"cost": 0.6, "tokens": None})
    by = {r["cell_id"]: r for r in made.collect()}
    whole, a, b, c = by[None], by["a"], by["b"], by["c"]
    assert (whole["accepted"], whole["judged"], whole["fidelity"], whole["candidates"], whole["quota"]) == (3, 2, 0.5, 6, 6) and whole["yield"] == 0.5
    assert (a["fidelity"], a["candidates"], a["fill"], b["fidelity"], b["candidates"], b["fill"], c["fill"], c["accepted"]) == (0.5, 3, 1.0, None, 3, 0.25, 1.0, 0)
    assert (whole["min_cell_fill"], whole["short_cells"], round(whole["cells_at_quota"], 6)) == (0.25, 1, 0.666667)
    assert abs(whole["residual_error"] - (0.1 + 0.3 + 0.3) / 3) < 1e-9 and abs(a["residual_error"] - 0.2) < 1e-9
    assert (whole["governance_violations"], a["governance_violations"], b["governance_violations"], c["governance_violations"]) == (1, 1, 0, 0)
    assert (whole["overlap_max"], a["overlap_max"], c["overlap_max"]) == (0.7, 0.4, None)
    assert a["balance_max_deviation"] == 0.5 and b["balance_max_deviation"] == 0 and abs(whole["balance_max_deviation"]) < 1e-9
    assert whole["kappa"] == 0.8 and a["kappa"] is None and abs(whole["cost_per_record"] - 0.2) < 1e-12 and whole["tokens_per_record"] is None
    assert abs(whole["distinct_2"] - 4 / 5) < 1e-9 and a["distinct_2"] == 3 / 4 and whole["self_bleu"] is not None and b["self_bleu"] is None
    fails = {(r["cell_id"], r["metric"], r["reason"]) for r in metrics.gate(metrics.gate_values(made), {"coverage_min_cell_fill": 0.5, "overlap_max": 0.7, "semantic_diversity_min": 1.0, "fidelity_min": None}, ("semantic_diversity_min",)).collect()}
    assert fails == {(None, "coverage_min_cell_fill", "below_min"), ("b", "coverage_min_cell_fill", "below_min"), (None, "governance_violations_max", "governance"), ("a", "governance_violations_max", "governance")}
    for bad in (("governance_violations_max",), ("nothing",)):
        with pytest.raises(metrics.GateError):
            metrics.gate(metrics.gate_values(made), {}, bad)
    with pytest.raises(ValueError, match="zz"):
        metrics.report(acc.withColumn("cell_id", F.lit("zz")), drops, cells)


def test_places_in_a_total_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, k int").repartition(9)
    got = {r["id"]: r["place"] for r in numbered(df, "k", F.col("id").desc(), name="place").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], -r[0]))]
    assert numbered(df.limit(0), "k").count() == 0


def test_conditional_samples(spark):
    slots = spark.createDataFrame([(i, "x" if i % 2 else "y", "q" if i % 10 == 0 else None) for i in range(2_000)], "slot bigint, scope string, tier string")
    fields = [{"name": "tier", "given": "scope", "by": {"x": {"p": 1.0, "r": 3.0}, "y": {"p": 1.0, "s": 0.0}}}, {"name": "mood", "weights": {"calm": 1.0, "rough": 1.0}, "when": "tier = 'p'"}]
    out = planning.conditional_sample(slots, fields, "7")
    rows = out.collect()
    assert out.repartition(5).select("slot", "tier", "mood").sort("slot").collect() == out.select("slot", "tier", "mood").sort("slot").collect()
    assert all(not r["valid"] and r["tier"] == "q" for r in rows if r["slot"] % 10 == 0)
    free = [r for r in rows if r["slot"] % 10]
    assert all(r["valid"] for r in free) and {r["tier"] for r in free if r["scope"] == "y"} == {"p"}
    share = sum(r["tier"] == "r" for r in free if r["scope"] == "x") / sum(r["scope"] == "x" for r in free)
    assert abs(share - 0.75) < 0.05 and all((r["mood"] is not None) == (r["tier"] == "p") for r in free)
    with pytest.raises(planning.PlanError):
        planning.choose(F.lit(0.5), {"a": 0.0})


def test_plans_and_samples(spark):
    cells, dropped = planning.build_plan(spark, {"axes": {"k": {"values": ["a", "b"]}, "l": {"values": ["x", "y"]}}, "balance": {"l": {"x": 0.75, "y": 0.25}}}, 20, constraint=lambda c: None if c["cell_id"] == "b|y" else c["params"])
    got = {r["cell_id"]: r["quota"] for r in cells.collect()}
    assert sum(got.values()) == 20 and got["a|y"] == 5 and [d["cell_id"] for d in dropped] == ["b|y"]
    with pytest.raises(planning.PlanError):
        planning.fit_shares([{"share": 1.0, "params": {"l": "x"}}], {"l": {"x": 0.5, "y": 0.5}})
    df = spark.range(500)
    one, two = ({r["id"] for r in planning.drawn(d, 40, "id", seed="s").collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 40 and {r["id"] for r in planning.drawn(df, 40, "id", seed="t").collect()} != one
    assert planning.drawn(df, 900, "id").count() == 500


def test_votes_that_mean_a_label(spark):
    b = spark.createDataFrame([(1, "yes"), (1, "yes"), (1, "no"), (1, None), (2, "yes"), (2, "no"), (3, None), (4, "odd")], "record_id int, vote string")
    labels = spark.createDataFrame([(1, "true"), (2, "true"), (3, "true"), (4, "true")], "record_id int, label string")
    got = {r["record_id"]: (r["agree"], r["cast_votes"], r["code"]) for r in judging.vote_agreement(b, labels, {"yes": "true", "no": "false"}).collect()}
    assert got == {1: (2, 3, None), 2: (1, 2, "consistency_disagrees"), 3: (0, 0, "consistency_no_votes"), 4: (0, 1, "consistency_disagrees")}


def test_small_sides_over_the_bound_take_several_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=6))) for i in range(60)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    items = texts.filter("id < 25").withColumnRenamed("id", "item_id")
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(5)]) for i in range(40)] + [(40, [0.0] * 5), (41, None)], "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, overlap.best_match(texts, items).collect())), sorted((r["query_id"], r["rank"], r["vec_id"]) for r in overlap.nearest_vectors(vectors, vectors, 3).collect())
    monkeypatch.setattr(overlap, "MAX_ITEMS", 7)
    parts = sorted(map(tuple, overlap.best_match(texts, items).collect())), sorted((r["query_id"], r["rank"], r["vec_id"]) for r in overlap.nearest_vectors(vectors, vectors, 3).collect())
    assert whole == parts and len(whole[1]) == 120
    assert overlap.best_match(texts, items.limit(0)).count() == 0 == overlap.nearest_vectors(vectors.limit(0), vectors).count()


def test_overlap_with_any_key(spark):
    texts = spark.createDataFrame([("r", "some words here")], "id string, text string")
    items = spark.createDataFrame([("f:2", "some words here"), ("f:1", "some words here")], "item_id string, text string")
    assert [tuple(r) for r in overlap.best_match(texts, items).collect()] == [("r", "f:1", 1.0)]
