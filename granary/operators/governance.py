"""Governance scans of records: findings by rule, sensitive identifiers, tool leaks; nothing that was matched is kept on request."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import scanners as S
from granary.functions import text as text_functions
from granary.session import ship


def explode_messages(records: DataFrame, id_col: str = "seed_id") -> DataFrame:
    """``id, path, turn, role, text``: one row per message, path as ``messages[i].content``; null messages give none."""
    return records.select(F.col(id_col).alias("id"), F.posexplode("messages").alias("i", "m")).select("id", F.format_string("messages[%d].content", F.col("i")).alias("path"), F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def public_strings(fields: T.StructType, skip: tuple[str, ...] = ()) -> Column:
    """Every string of a record's public columns as an array of (path, text), depth first, with paths like
    ``messages[1].content``.

    Columns and fields with a leading underscore are private. Structs, arrays and maps are followed to any depth; nulls
    give nothing. The schema decides the walk, so it is one expression."""
    entry = "array<struct<path:string,text:string>>"
    none = F.array().cast(entry)

    def strings_in(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(strings_in(f.dataType) for f in kind.fields if not f.name.startswith("_"))
        return isinstance(kind, T.StringType) or isinstance(kind, T.ArrayType) and strings_in(kind.elementType) or isinstance(kind, T.MapType) and strings_in(kind.valueType)

    def walk(value: Column, kind: T.DataType, path: Column) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("text")))).otherwise(none)
        if isinstance(kind, T.StructType):
            return F.concat(*[walk(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if not f.name.startswith("_") and strings_in(f.dataType)])
        if isinstance(kind, T.ArrayType):
            inner = F.transform(value, lambda v, i: walk(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        else:
            inner = F.transform(F.map_entries(value), lambda e: F.when(e["key"].cast("string").startswith("_"), none).otherwise(walk(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
        return F.coalesce(F.flatten(inner), none)

    parts = [walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in fields.fields if not f.name.startswith("_") and f.name not in skip and strings_in(f.dataType)]
    return F.concat(none, *parts)


def explode_strings(records: DataFrame, id_col: str = "seed_id") -> DataFrame:
    """``id, path, text``: a row per public string of each record."""
    return records.select(F.col(id_col).alias("id"), F.explode(public_strings(records.schema, (id_col,))).alias("s")).select("id", "s.path", "s.text")


def record_text(records: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """What a record says: its messages' contents if it has any message with one, else all its public strings, joined by line
    breaks and trimmed."""
    whole = text_functions.strip(F.array_join(F.transform(public_strings(records.schema, skip), lambda s: s["text"]), "\n"))
    if "messages" not in records.columns:
        return whole
    return F.when(F.exists("messages", lambda m: m["content"].isNotNull()), text_functions.record_text(F.col("messages"))).otherwise(whole)


#: One finding: where, which rule, which engine, how sure; ``matched`` is the text and never leaves a report.
FINDING = "array<struct<start:int,end:int,rule:string,engine:string,scanner:string,score:double,matched:string>>"


class RuleScanner:
    """Findings of named patterns as one column expression."""

    def __init__(self, scanner: str, rules: dict[str, str], engine: str = "regex"):
        self.scanner, self.rules, self.engine = scanner, rules, engine

    def findings(self, text: Column) -> Column:
        one = lambda rule: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule).alias("rule"), F.lit(self.engine).alias("engine"), F.lit(self.scanner).alias("scanner"), F.lit(1.0).alias("score"), s["text"].alias("matched"))
        # positions are computed only where a rule matches at all
        parts = [F.when(S.has(text, p), F.transform(S.found_spans(text, p), one(rule))).otherwise(F.array().cast(FINDING)) for rule, p in self.rules.items()]
        return F.concat(*parts) if parts else F.array().cast(FINDING)


class EntityScanner:
    """Denied names that lie within no allowed one; the rule is the name in lower case, white space collapsed."""

    scanner, engine = "entities", "list"

    def __init__(self, deny: list[str], allow: list[str] = ()):
        self.deny, self.allow = list(deny), list(allow)

    def findings(self, text: Column) -> Column:
        if not self.deny:
            return F.array().cast(FINDING)
        deny = S.entity_pattern(self.deny)
        found = S.found_spans(text, deny)
        kept = S.uncovered(found, S.found_spans(text, S.entity_pattern(self.allow))) if self.allow else found
        named = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(F.regexp_replace(s["text"], r"(?U)\s+", " ")).alias("rule"), F.lit(self.engine).alias("engine"), F.lit(self.scanner).alias("scanner"), F.lit(1.0).alias("score"), s["text"].alias("matched")))
        return F.when(S.has(text, deny), named).otherwise(F.array().cast(FINDING))


class EngineScanner:
    """Adapter of an outside engine: ``make`` builds, once per task, a function from a text to (rule, start, end, score).

    ``module`` is what it needs; a missing one raises when the adapter is made, with its name."""

    def __init__(self, scanner: str, engine: str, module: str | None, make):
        self.scanner, self.engine, self.make = scanner, engine, make
        if module is not None and importlib.util.find_spec(module) is None:
            raise EngineError(f"{engine} needs the package {module!r}, which is not installed")

    def findings(self, text: Column) -> Column:
        make, scanner, engine = self.make, self.scanner, self.engine

        @F.pandas_udf("array<struct<start:int,end:int,rule:string,engine:string,scanner:string,score:double,matched:string>>")
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found = make()
            for texts in batches:
                yield pd.Series([[] if t is None else [{"start": s, "end": e, "rule": r, "engine": engine, "scanner": scanner, "score": float(p), "matched": t[s:e]} for r, s, e, p in found(t)] for t in texts])

        return scan(text)


class EngineError(RuntimeError):
    """An optional engine is missing."""


#: Entity names of an outside analyser and the rules they count as; others count under their own name.
PRESIDIO_RULES = {
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
    "AU_ABN": "abn",
    "AU_TFN": "tfn",
    "AU_ACN": "acn",
    "AU_MEDICARE": "medicare",
    "CREDIT_CARD": "credit_card",
    "IBAN_CODE": "account_number",
    "PERSON": "person",
    "LOCATION": "location",
    "IP_ADDRESS": "ip_address",
}
#: Labels of an outside classifier and the categories they count as; its other labels are not used.
DETOXIFY_RULES = {
    "obscene": "profanity",
    "insult": "insult",
    "threat": "threat",
    "identity_attack": "identity_attack",
    "identity_hate": "identity_attack",
    "sexual_explicit": "sexual",
}


def presidio_scanner(least: float = 0.5, language: str = "en", analyzer=None) -> EngineScanner:
    """Personal data by an analyser: that which ``analyzer`` makes, else the installed one; EngineError where there is none."""

    def make():
        if analyzer is None:
            from presidio_analyzer import AnalyzerEngine as build
        else:
            build = analyzer
        engine = build()
        return lambda t: [(PRESIDIO_RULES.get(r.entity_type, r.entity_type.lower()), r.start, r.end, r.score) for r in engine.analyze(text=t, language=language) if r.score >= least]

    return EngineScanner("pii", "presidio", "presidio_analyzer" if analyzer is None else None, make)


def detoxify_scanner(least: float = 0.5, exceptions: frozenset[str] = frozenset(), classifier=None) -> EngineScanner:
    """Toxic texts by a classifier: that which ``classifier`` makes, else the installed one. A category's finding is the whole
    text, with the largest score of its labels."""

    def make():
        if classifier is None:
            from detoxify import Detoxify

            scorer = Detoxify("original")
        else:
            scorer = classifier()

        def found(t: str):
            best: dict[str, float] = {}
            for label, p in scorer.predict(t).items() if t.strip() else ():
                rule = DETOXIFY_RULES.get(label)
                if rule and rule not in exceptions and p >= least:
                    best[rule] = max(best.get(rule, 0.0), float(p))
            return [(rule, 0, len(t), p) for rule, p in best.items()]

        return found

    return EngineScanner("toxicity", "detoxify", "detoxify" if classifier is None else None, make)


class Composite:
    """Several scanners or engines as one: all findings, equal ones once, in order of place, end, rule and engine."""

    def __init__(self, *scanners):
        self.scanners = scanners

    def findings(self, text: Column) -> Column:
        every = F.array_distinct(F.concat(F.array().cast(FINDING), *[s.findings(text) for s in self.scanners]))
        return F.array_sort(every)  # fields are in the order of the sort


def scan(texts: DataFrame, scanner) -> DataFrame:
    """``id, path, scanner, rule, start, end, engine, score, matched`` of a scanner over ``texts`` (id, path, text)."""
    ship(texts.sparkSession)  # for engines, which run in Python
    found = texts.select("id", "path", F.explode(Composite(scanner).findings(F.col("text"))).alias("s"))
    return found.select("id", "path", "s.scanner", "s.rule", "s.start", "s.end", "s.engine", "s.score", "s.matched")


def scan_pii(texts: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Findings of the personal-data rules in ``texts`` (id, path, text), with positions; null texts have none."""
    return scan(texts, RuleScanner("pii", S.PII | (extra or {})))


def scan_toxicity(texts: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the keyword categories but ``exceptions``."""
    return scan(texts, RuleScanner("toxicity", {c: S.toxicity_pattern(c) for c in S.TOXICITY if c not in exceptions}, "keywords"))


def scan_secrets(texts: DataFrame) -> DataFrame:
    return scan(texts, RuleScanner("secrets", S.SECRETS))


def scan_entities(texts: DataFrame, deny: list[str], allow: list[str] = ()) -> DataFrame:
    """Denied names that do not lie within an allowed one."""
    return scan(texts, EntityScanner(deny, allow))


def uncovered_identifiers(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Spans of runs of six digits or more that no personal-data finding covers."""
    pii = F.concat(*[S.found_spans(text, p) for p in (S.PII | (extra or {})).values()])
    return F.when(S.has(text, S.IDENTIFIER), S.uncovered(S.found_spans(text, S.IDENTIFIER), pii)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def sensitive_identifiers(texts: DataFrame) -> DataFrame:
    """``id, path, scanner, rule, start, end, matched`` of identifiers in ``texts`` that no personal-data finding covers."""
    return texts.select("id", "path", F.explode(uncovered_identifiers(F.col("text"))).alias("s")).select("id", "path", F.lit("sensitive").alias("scanner"), F.lit("identifier").alias("rule"), "s.start", "s.end", F.col("s.text").alias("matched"))


def is_sensitive(label: Column) -> Column:
    """Whether a tool's label makes its data sensitive: anything but null, empty and ``public``."""
    return ~F.coalesce(label, F.lit("")).isin("", "public")


def squeezed(x: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    return text_functions.strip(text_functions.casefold(F.regexp_replace(x, r"(?U)\s+", " ")))


def tool_leaks(texts: DataFrame, traces: DataFrame, least: int = 6) -> DataFrame:
    """Values of sensitive tool results (traces: id, tool, sensitivity, value) of ``least`` characters or more that stand in
    the same record's texts, by path and value once. Values are hashed: a leak report must not leak."""
    needles = traces.filter(is_sensitive(F.col("sensitivity"))).select("id", "tool", squeezed(F.col("value")).alias("needle")).filter(F.length("needle") >= least).dropDuplicates(["id", "needle"])
    return texts.join(needles, "id").filter(F.contains(squeezed(F.col("text")), F.col("needle"))).select("id", "path", "tool", F.sha2("needle", 256).alias("value_hash")).distinct()


def redacted(findings: DataFrame) -> DataFrame:
    """Findings without the matched text."""
    return findings.drop("matched")


def issue_code(scanner: Column, rule: Column) -> Column:
    """``entity_denied`` for names, else scanner and rule."""
    return F.when(scanner == "entities", "entity_denied").otherwise(F.concat_ws("_", scanner, rule))


# ---------------------------------------------------------------------------- profiles


class ProfileError(ValueError):
    """A governance section that contradicts itself."""


class LooseningError(ProfileError):
    """A profile that is less strict than its base without a documented exception."""


@dataclass(frozen=True)
class Profile:
    """Which rules hold. A task may add rules; it may take one away only as a documented exception (rule, reason), and never
    one on personal data or secrets."""

    pii_rules: frozenset[str] = frozenset(S.PII)
    pii_patterns: tuple[tuple[str, str], ...] = ()
    toxicity: frozenset[str] = frozenset(S.TOXICITY)
    toxicity_exceptions: frozenset[str] = frozenset()
    secrets: frozenset[str] = frozenset(S.SECRETS)
    deny: frozenset[str] = frozenset()
    allow: frozenset[str] = frozenset()
    exceptions: tuple[tuple[str, str], ...] = ()

    def scanner(self, *engines) -> Composite:
        """All rules of the profile, and further engines, as one scanner."""
        rules = {n: S.PII[n] for n in sorted(self.pii_rules)} | dict(self.pii_patterns)
        toxic = {c: S.toxicity_pattern(c) for c in sorted(self.toxicity - self.toxicity_exceptions)}
        return Composite(RuleScanner("pii", rules), RuleScanner("toxicity", toxic, "keywords"), RuleScanner("secrets", {n: S.SECRETS[n] for n in sorted(self.secrets)}), EntityScanner(sorted(self.deny), sorted(self.allow)), *engines)


def _documented(exceptions: list[dict]) -> dict[tuple[str, str], dict]:
    out: dict[tuple[str, str], dict] = {}
    for e in exceptions:
        scanner, _, name = (p.strip() for p in e["rule"].partition(":"))
        if not name or scanner not in ("pii", "toxicity", "secrets", "entities"):
            raise ProfileError(f"{e['rule']!r} names no rule: write scanner:name")
        if scanner not in ("toxicity", "entities"):
            raise LooseningError(f"{e['rule']!r}: {scanner} rules have no exceptions")
        if (scanner, name) in out:
            raise ProfileError(f"{e['rule']!r} is declared twice")
        out[scanner, name] = e
    return out


def merge_profile(section: dict | None, base: Profile = Profile()) -> Profile:
    """``base`` with a task's section: extra_pii_patterns, toxicity_exceptions, entity_deny, entity_allow, exceptions."""
    section = section or {}
    declared = _documented(section.get("exceptions", []))
    patterns, excepted = dict(section.get("extra_pii_patterns", {})), set(section.get("toxicity_exceptions", []))
    deny, allow = set(section.get("entity_deny", [])), set(section.get("entity_allow", []))
    for name, p in patterns.items():
        if name in base.pii_rules or dict(base.pii_patterns).get(name, p) != p:
            raise LooseningError(f"extra_pii_patterns.{name} would redefine a rule")
    if unknown := excepted - base.toxicity:
        raise ProfileError(f"toxicity_exceptions: unknown categories {sorted(unknown)}")
    if both := deny & allow:
        raise ProfileError(f"names both denied and allowed: {sorted(both)}")
    released = allow & base.deny
    needed = {("toxicity", c) for c in excepted} | {("entities", e) for e in released}
    if missing := needed - declared.keys():
        raise LooseningError(f"no documented exception for {sorted(':'.join(m) for m in missing)}")
    if idle := declared.keys() - needed:
        raise ProfileError(f"exceptions that relax nothing: {sorted(':'.join(m) for m in idle)}")
    out = replace(
        base,
        pii_patterns=tuple(sorted((dict(base.pii_patterns) | patterns).items())),
        toxicity_exceptions=base.toxicity_exceptions | excepted,
        deny=(base.deny - released) | deny,
        allow=base.allow | allow,
        exceptions=base.exceptions + tuple((e["rule"], e.get("reason", "")) for e in declared.values()),
    )
    check_tightens(base, out)
    return out


def check_tightens(base: Profile, profile: Profile) -> None:
    """Raise unless ``profile`` is at least as strict as ``base`` but for its declared exceptions."""
    declared = {tuple(p.strip() for p in rule.split(":", 1)) for rule, _ in profile.exceptions}
    problems = [f"{name} dropped: {sorted(gone)}" for name in ("pii_rules", "secrets", "toxicity") if (gone := getattr(base, name) - getattr(profile, name))]
    own = dict(profile.pii_patterns)
    problems += [f"pattern {n} removed or changed" for n, p in base.pii_patterns if own.get(n) != p]
    problems += [f"category {c} excepted without a reason" for c in sorted(profile.toxicity_exceptions - base.toxicity_exceptions) if ("toxicity", c) not in declared]
    problems += [f"name {e} released without a reason" for e in sorted(base.deny - profile.deny) if ("entities", e) not in declared]
    if problems:
        raise LooseningError("; ".join(problems))
