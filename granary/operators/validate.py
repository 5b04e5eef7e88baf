"""Validation layers as column expressions: each gives an array of issues, and layers are folded so that the first failure ends a record's run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text
from granary.operators import governance, overlap
from granary.session import arrow_map, cut

ISSUE = "array<struct<code:string,path:string>>"


def no_issues() -> Column:
    return F.array().cast(ISSUE)


def issue(when: Column, code: str, path: Column | str) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), p.alias("path")))).otherwise(no_issues())


def schema_issues(required: list[str] = (), enums: dict[str, list[str]] | None = None, min_length: dict[str, int] | None = None, min_items: dict[str, int] | None = None) -> Column:
    """``schema_required``, ``schema_enum``, ``schema_minLength`` and ``schema_minItems`` by path; a null optional field is no issue."""
    parts = [issue(F.col(c).isNull(), "schema_required", c) for c in required]
    parts += [issue(F.col(c).isNotNull() & ~F.col(c).isin(v), "schema_enum", c) for c, v in (enums or {}).items()]
    parts += [issue(F.length(c) < n, "schema_minLength", c) for c, n in (min_length or {}).items()]
    parts += [issue(F.size(c) < n, "schema_minItems", c) for c, n in (min_items or {}).items()]
    return F.array_sort(F.concat(no_issues(), *parts), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).when(a["code"] < b["code"], -1).otherwise(1))


def turn_issues(messages: Column, roles: list[str], first_role: str | None = None, numbered_from: int = 1, alternating: bool = True) -> Column:
    """``turn_numbering``, ``unknown_role``, ``first_role`` and ``role_alternation`` by message, in message order."""
    start = roles.index(first_role or roles[0])
    allowed = F.array(*[F.lit(r) for r in roles])

    def one(m: Column, i: Column) -> Column:
        at = F.format_string("messages[%d]", i)
        known = F.coalesce(F.array_contains(allowed, m["role"]), F.lit(False))
        expected = F.element_at(allowed, F.pmod(i + start, F.lit(len(roles))) + 1) if alternating else F.when(i == 0, F.lit(first_role or roles[0]))
        wrong = known & expected.isNotNull() & (m["role"] != expected)
        return F.concat(
            issue(~m["turn"].eqNullSafe(i + numbered_from), "turn_numbering", F.concat(at, F.lit(".turn"))),
            issue(~known, "unknown_role", F.concat(at, F.lit(".role"))),
            issue(wrong & (i == 0), "first_role", F.concat(at, F.lit(".role"))),
            issue(wrong & (i > 0), "role_alternation", F.concat(at, F.lit(".role"))),
        )

    return F.coalesce(F.flatten(F.transform(messages, one)), no_issues())


def span_issues(messages: Column, spans: Column) -> Column:
    """``span_turn`` where a span names no turn of the record, ``span_text`` where its text is no part of that turn's content."""

    def one(s: Column, i: Column) -> Column:
        at = F.format_string("spans[%d]", i)
        same = F.filter(messages, lambda m: m["turn"] == s["turn"])
        inside = F.exists(same, lambda m: F.coalesce(F.contains(m["content"], s["text"]), F.lit(False)))
        return F.concat(issue(F.size(same) == 0, "span_turn", at), issue((F.size(same) > 0) & ~inside, "span_text", at))

    return F.coalesce(F.flatten(F.transform(spans, one)), no_issues())


def keyword_issues(x: Column, name: str, forbidden: list[str] = (), required_any: list[str] = (), required_all: list[str] = (), match: str = "substring", case: bool = False, when: Column | None = None) -> Column:
    """Keyword rule ``name`` on one text: an issue per forbidden keyword, one for no required keyword, one per missing one.

    ``match``: substring, word or regex. Without ``case``, case is ignored. ``when`` restricts the records it holds for."""
    import re

    def hit(k: str) -> Column:
        p = k if match == "regex" else re.escape(k)
        if match == "word":
            p = text.unicode_classes(rf"(?<!\w){p}(?!\w)")
        return F.coalesce(x.rlike(p if case else f"(?iu){p}"), F.lit(False))

    on = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    parts = [issue(on & hit(k), f"{name}:{k}", name) for k in forbidden]
    if required_any:
        anyone = hit(required_any[0])
        for k in required_any[1:]:
            anyone = anyone | hit(k)
        parts.append(issue(on & ~anyone, f"{name}:required_any", name))
    parts += [issue(on & ~hit(k), f"{name}:{k}", name) for k in required_all]
    return F.concat(no_issues(), *parts)


def matches_when(conditions: dict[str, object]) -> Column:
    """Equality on every field, null-safe; a list means one of its values."""
    out = F.lit(True)
    for c, v in conditions.items():
        out = out & (F.col(c).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(c).eqNullSafe(F.lit(v)))
    return out


def json_schema_issues(schema: dict, fields: T.StructType) -> Column:
    """Issues of a JSON schema over typed columns, as ``schema_<keyword>`` by path, in order of path and code.

    Objects are structs, arrays are arrays: ``required`` (a null counts as missing), ``enum``, ``minLength``, ``maxLength``,
    ``pattern``, ``minimum``, ``maximum``, ``minItems``, ``maxItems``, ``properties`` and ``items`` at any depth; ``type`` is
    held against the column's type, and a property that has no column is ``schema_required`` where it is required. Nulls of
    fields that are not required are no issue."""

    def check(value: Column, rule: dict, kind: T.DataType, path: Column) -> list[Column]:
        out = []
        wanted = rule.get("type")
        wanted = [wanted] if isinstance(wanted, str) else wanted
        if wanted and not set(wanted) & set(_JSON_TYPES.get(type(kind), ())):
            out.append(issue(value.isNotNull(), "schema_type", path))
            return out
        if "enum" in rule:
            out.append(issue(value.isNotNull() & ~value.isin([v for v in rule["enum"] if v is not None]), "schema_enum", path))
        for name, holds in (("minLength", lambda n: F.length(value) >= n), ("maxLength", lambda n: F.length(value) <= n), ("pattern", lambda p: value.rlike(text.unicode_classes(p))), ("minimum", lambda n: value >= n), ("maximum", lambda n: value <= n), ("minItems", lambda n: F.size(value) >= n), ("maxItems", lambda n: F.size(value) <= n)):
            if name in rule:
                out.append(issue(value.isNotNull() & ~holds(rule[name]), f"schema_{name}", path))
        if isinstance(kind, T.StructType):
            out += _properties(rule, kind, lambda n: value[n], value.isNotNull(), lambda n: F.concat(path, F.lit(f".{n}")), path, check)
        if isinstance(kind, T.ArrayType) and "items" in rule:
            inner = F.transform(value, lambda v, i: F.concat(no_issues(), *check(v, rule["items"], kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            out.append(F.coalesce(F.flatten(inner), no_issues()))
        return out

    parts = _properties(schema, fields, lambda n: F.col(f"`{n}`"), F.lit(True), F.lit, F.lit(None).cast("string"), check)
    return F.array_sort(F.concat(no_issues(), *parts), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0))


#: Types a column of each kind satisfies.
_JSON_TYPES = {T.StringType: ("string",), T.BooleanType: ("boolean",), T.IntegerType: ("integer", "number"), T.LongType: ("integer", "number"), T.ShortType: ("integer", "number"), T.DoubleType: ("number",), T.FloatType: ("number",), T.ArrayType: ("array",), T.StructType: ("object",), T.MapType: ("object",)}


def _properties(rule: dict, kind: T.StructType, get, present: Column, path, missing_at: Column, check) -> list[Column]:
    have = {f.name: f.dataType for f in kind.fields}
    out = []
    for name in rule.get("required", ()):
        gone = get(name).isNull() if name in have else F.lit(True)
        out.append(issue(present & gone, "schema_required", path(name)))
    for name, inner in rule.get("properties", {}).items():
        if name in have:
            out += check(get(name), inner, have[name], path(name))
    return out


def answer_issues(response: Column, answer: Column, read: Callable[[Column], Column]) -> Column:
    """``response_answer`` where ``read`` finds no answer in a response, or another one than ``answer``; a null response or a
    null answer can't disagree."""
    found = read(response)
    wrong = response.isNotNull() & (found.isNull() | (answer.isNotNull() & (answer != found)))
    return issue(wrong, "response_answer", "response")


def option_issues(question: Column, response: Column, answer: Column) -> Column:
    """``option`` where a question lists fewer than two options, or the chosen one (the answer, else the response's) is none of them."""
    labels = text.option_labels(question)
    chosen = F.coalesce(F.nullif(answer, F.lit("")), text.choice_answer(F.nullif(response, F.lit(""))))
    wrong = question.isNotNull() & ((F.size(labels) < 2) | (chosen.isNotNull() & ~F.array_contains(labels, chosen)))
    return issue(wrong, "option", "question")


def first_of(*steps: Column) -> Column:
    """The issues of the first step that has any: later checks of a layer need what earlier ones hold."""
    out = no_issues()
    for s in reversed(steps):
        out = F.when(F.size(F.coalesce(s, no_issues())) > 0, s).otherwise(out)
    return out


def rule_issues(rule: dict, messages: Column | None = None) -> Column:
    """A keyword rule over texts: ``kind`` forbidden or required, ``keywords``, ``match`` (substring, word, regex),
    ``case_sensitive``, ``require`` (any, all), ``roles`` and ``fields`` to read, ``when``.

    ``keyword_forbidden`` for each text and keyword found in it, by its path; ``keyword_required`` for a rule none of whose
    keywords (any), or for each keyword that (all), stands in no text."""
    import re

    flags = "" if rule.get("case_sensitive") else "(?iu)"
    make = {"regex": lambda k: k, "word": lambda k: rf"(?<!\w){re.escape(k)}(?!\w)", "substring": re.escape}[rule.get("match", "substring")]
    patterns = [flags + text.unicode_classes(make(k)) for k in rule["keywords"]]
    entry = "array<struct<path:string,text:string>>"
    texts = F.array().cast(entry)
    if messages is not None:
        roles = rule.get("roles")
        listed = F.transform(messages, lambda m, i: F.struct(F.format_string("messages[%d].content", i).alias("path"), F.when(m["role"].isin(list(roles)) if roles is not None else F.lit(True), m["content"]).alias("text")))
        texts = F.concat(texts, F.coalesce(F.filter(listed, lambda t: t["text"].isNotNull()), F.array().cast(entry)))
    for name in rule.get("fields", ()):
        texts = F.concat(texts, F.when(F.col(name).isNotNull(), F.array(F.struct(F.lit(name).alias("path"), F.col(name).alias("text")))).otherwise(F.array().cast(entry)))
    on = matches_when(rule.get("when", {}))
    if rule["kind"] == "forbidden":
        hits = F.flatten(F.transform(texts, lambda t: F.concat(no_issues(), *[issue(t["text"].rlike(p), "keyword_forbidden", t["path"]) for p in patterns])))
        return F.when(on, hits).otherwise(no_issues())
    stands = lambda p: F.exists(texts, lambda t: t["text"].rlike(p))
    found = [stands(p) for p in patterns]
    nowhere = F.lit(None).cast("string")
    if rule.get("require", "any") == "all":
        return F.concat(no_issues(), *[issue(on & ~f, "keyword_required", nowhere) for f in found])
    anyone = found[0]
    for f in found[1:]:
        anyone = anyone | f
    return issue(on & ~anyone, "keyword_required", nowhere)


def label_issues(label: Column, expected: Column, computable: Column | None = None) -> Column:
    """``label_disagrees`` where the label is not what the record's facts imply, ``label_rule_error`` where they imply nothing.

    Labels are compared as JSON text, so that true is neither "true" nor 1."""
    known = expected.isNotNull() if computable is None else computable
    return F.when(~known, issue(F.lit(True), "label_rule_error", "label")).otherwise(issue(~label.eqNullSafe(expected), "label_disagrees", "label"))


def extra_issues(df: DataFrame, validator: Callable[[dict], list], id_col: str) -> DataFrame:
    """``id, issues`` of a Python validator (errors of a record as strings or (code, path)), in Arrow batches; what it raises
    on a record is that record's ``extra_validator_error``."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    found = [("extra_validator", None) if isinstance(e, str) else e for e in validator(r)]
                except (KeyError, TypeError, ValueError, AttributeError, IndexError):
                    found = [("extra_validator_error", None)]
                out.append([{"code": c, "path": p} for c, p in found])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.list_(pa.struct([("code", pa.string()), ("path", pa.string())])))], ["id", "issues"])

    return arrow_map(df, run, f"id {kind}, issues {ISSUE}")


def governance_issues(messages: Column, scanner, sensitive: Column | None = None) -> Column:
    """Codes of a governance scanner's findings in every message; where ``sensitive`` (the record was built on sensitive tool
    data), also ``sensitive_identifier`` for identifiers that no personal-data rule covers."""

    def of(m: Column, i: Column) -> Column:
        at = F.format_string("messages[%d].content", i)
        found = F.transform(scanner.findings(m["content"]), lambda f: F.struct(governance.issue_code(f["scanner"], f["rule"]).alias("code"), at.alias("path")))
        if sensitive is not None:
            ids = F.transform(governance.uncovered_identifiers(m["content"]), lambda _: F.struct(F.lit("sensitive_identifier").alias("code"), at.alias("path")))
            found = F.concat(found, F.when(F.coalesce(sensitive, F.lit(False)), ids).otherwise(no_issues()))
        return F.coalesce(found, no_issues())

    return F.coalesce(F.flatten(F.transform(messages, of)), no_issues())


def same_label(a: Column, a_type: Column, b: Column, b_type: Column) -> Column:
    """Type-strict equality of labels held as text and type name: true is not 1."""
    return a.eqNullSafe(b) & a_type.eqNullSafe(b_type)


def cascade(df: DataFrame, layers: list[tuple[str, Column, bool]]) -> DataFrame:
    """Adds ``outcome`` (pass, fail_repairable, fail_hard), ``layer`` and ``issues``: layers (name, issues, hard) in order,
    each evaluated only where all before it passed. A null array counts as no issue."""
    done = F.struct(F.lit("pass").alias("outcome"), F.lit(None).cast("string").alias("layer"), no_issues().alias("issues"))
    for name, issues, hard in reversed(layers):
        failed = F.struct(F.lit("fail_hard" if hard else "fail_repairable").alias("outcome"), F.lit(name).alias("layer"), issues.alias("issues"))
        done = F.when(F.size(F.coalesce(issues, no_issues())) > 0, failed).otherwise(done)
    return df.withColumn("_v", done).select(*df.columns, "_v.outcome", "_v.layer", "_v.issues")


#: Layers, cheapest first; layers all of whose issues end a record, and other issues that do.
LAYERS = ("L1", "L2", "L3", "L4", "L5", "L6")
HARD_LAYERS = {"L3", "L4"}
HARD_CODES = ("judge_error", "sent_to_review", "consistency_no_votes")


class CascadeError(ValueError):
    pass


@dataclass
class Layer:
    """A layer's issues: a column over the record, or a function from the records that reach the layer to (id, issues)."""

    name: str
    issues: Column | Callable[[DataFrame], DataFrame]


def run_cascade(records: DataFrame, layers: list[Layer], id_col: str = "id") -> DataFrame:
    """``records`` with ``outcome, layer, issues``: the first layer that objects, or a pass.

    Layers come in the order L1 to L6, none twice. Column layers are folded into one projection. A layer that needs other
    rows (overlap, judges, votes) sees only records that all layers before it passed, and is joined back by id."""
    names = [x.name for x in layers]
    if unknown := [n for n in names if n not in LAYERS]:
        raise CascadeError(f"unknown layers {unknown}")
    if names != sorted(set(names), key=LAYERS.index):
        raise CascadeError(f"layers must not repeat and must run cheapest first: {names}")
    empty = F.struct(F.lit(None).cast("string").alias("layer"), no_issues().alias("issues"))
    out, verdict, waiting = records, empty, []

    def fold(found: Column) -> Column:
        for x in reversed(waiting):
            found = F.when(F.size(F.coalesce(x.issues, no_issues())) > 0, F.struct(F.lit(x.name).alias("layer"), x.issues.alias("issues"))).otherwise(found)
        return found

    for x in layers:
        if isinstance(x.issues, Column):
            waiting.append(x)
            continue
        first = F.coalesce(verdict, empty) if verdict is not empty else empty
        out = cut(out.withColumn("_v", F.when(first["layer"].isNotNull(), first).otherwise(fold(empty))))
        waiting, verdict = [], F.col("_v")
        found = x.issues(out.filter("_v.layer is null").select(*records.columns)).select(F.col("id").alias("_id"), F.col("issues").alias("_own"))
        joined = out.join(found, out[id_col] == found["_id"], "left")
        own = F.coalesce("_own", no_issues())
        out = joined.withColumn("_v", F.when(F.col("_v.layer").isNull() & (F.size(own) > 0), F.struct(F.lit(x.name).alias("layer"), own.alias("issues"))).otherwise(F.col("_v"))).drop("_id", "_own")
    out = out.withColumn("_v", F.when(verdict["layer"].isNotNull(), verdict).otherwise(fold(empty)))
    layer, issues = F.col("_v.layer"), F.col("_v.issues")
    hard = layer.isin(*HARD_LAYERS) | F.exists(issues, lambda i: i["code"].isin(*HARD_CODES))
    outcome = F.when(layer.isNull(), "pass").when(hard, "fail_hard").otherwise("fail_repairable")
    return out.select(*records.columns, outcome.alias("outcome"), layer.alias("layer"), issues.alias("issues"))


def overlap_issues(held_out: DataFrame, seeds: DataFrame | None = None, corpus: DataFrame | None = None, limit: float = 0.8, id_col: str = "id", text_of: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Layer L4 as a function for :func:`run_cascade`: ``held_out_overlap``, ``seed_overlap`` and ``near_duplicate`` where the
    best match of a record among held-out items, seeds and accepted records (item_id, text) is over the limit, not equal to it."""

    def check(records: DataFrame) -> DataFrame:
        own = records.select(F.col(id_col).alias("id"), (F.col("text") if text_of is None else text_of).alias("text"))
        parts = []
        for code, items in (("held_out_overlap", held_out), ("seed_overlap", seeds), ("near_duplicate", corpus)):
            if items is not None:
                parts.append(overlap.best_match(own, items).filter(F.col("score") > limit).select("id", F.lit(code).alias("code")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", F.lit(None).cast("string").alias("path")))).cast(ISSUE).alias("issues"))

    return check


def judge_issues(judged: DataFrame, low: float = 0.6, review: bool = False, id_col: str = "id") -> Callable[[DataFrame], DataFrame]:
    """Layer L5 as a function: ``judged`` has id, verdict, label, confidence (null verdict: unusable output). Unusable output
    is ``judge_error`` or goes to review, so does low confidence where there is a review; another verdict is ``judge_disagrees``."""

    def check(records: DataFrame) -> DataFrame:
        j = records.select(F.col(id_col).alias("id")).join(judged, "id")
        code = F.when(F.col("verdict").isNull(), "sent_to_review" if review else "judge_error").when(F.lit(review) & (F.col("confidence") < low), "sent_to_review").when(~F.col("verdict").eqNullSafe(F.col("label")), "judge_disagrees")
        return j.select("id", code.alias("code")).filter("code is not null").select("id", F.array(F.struct("code", F.when(F.col("code") == "judge_disagrees", "verdict").alias("path"))).cast(ISSUE).alias("issues"))

    return check


def vote_issues(codes: DataFrame, escalated: Column | None = None, trusted: DataFrame | None = None, id_col: str = "id") -> Callable[[DataFrame], DataFrame]:
    """Layer L6 as a function: ``codes`` (id, code; null: agreed) of votes hold for ``escalated`` records; those of ``trusted``
    (id), on which a trusted judge agreed with confidence, are skipped."""

    def check(records: DataFrame) -> DataFrame:
        r = records if escalated is None else records.filter(F.coalesce(escalated, F.lit(False)))
        r = r.select(F.col(id_col).alias("id"))
        if trusted is not None:
            r = r.join(trusted.select("id"), "id", "left_anti")
        return r.join(codes.filter("code is not null"), "id").select("id", F.array(F.struct("code", F.lit(None).cast("string").alias("path"))).cast(ISSUE).alias("issues"))

    return check


def escalates(always: bool = False, on_hard: bool = True, on_contestable: bool = True, low: Column | None = None) -> Column:
    """Whether a record goes to voting: always, low confidence, hard difficulty in any case, or contestable."""
    out = F.lit(always) | (F.coalesce(low, F.lit(False)) if low is not None else F.lit(False))
    if on_hard:
        out = out | F.coalesce(F.lower("difficulty") == "hard", F.lit(False))
    if on_contestable:
        out = out | F.coalesce(F.col("contestable"), F.lit(False))
    return out


def judge_outcomes(agree: Column, parsed: Column, low: Column, review: bool) -> Column:
    """The judge's table: no parse is hard, low confidence goes to review, disagreement is repairable, agreement passes."""
    return F.when(~F.coalesce(parsed, F.lit(False)), F.lit("judge_error")).when(F.coalesce(low, F.lit(False)) & F.lit(review), F.lit("sent_to_review")).when(F.coalesce(agree, F.lit(False)), F.lit("pass")).otherwise(F.lit("disagrees"))
