"""Run artefacts and releases: append logs, stage documents, immutable releases with hashes, review queues."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import filesystem, numbered, path_exists, read_file, write_file


class ReleaseError(ValueError):
    pass


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _sorted_keys(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of all its structs, and the entries of all its maps, in order of name."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[_sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _sorted_keys(v, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _sorted_keys(e["value"], kind.valueType))))
    return value


def canonical_row(df: DataFrame) -> Column:
    """The row as JSON with keys in order at every depth; private columns (leading underscore) are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[_sorted_keys(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(df.columns) if not c.startswith("_")]), {"ignoreNullFields": "false"})


def record_hash(df: DataFrame) -> Column:
    """sha256 of the canonical row and a line break."""
    return F.sha2(F.concat(canonical_row(df), F.lit("\n")), 256)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines with keys in order; Spark commits whole files, so there is never a partial line."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def stage(spark: SparkSession, path: str, spec_version: str, compute: Callable[[], object]) -> object:
    """The stored body of a stage, or the computed one, stored."""
    from granary.sources.records import read_stage

    if path_exists(spark, path):
        return read_stage(spark, path, spec_version)
    body = compute()
    write_file(spark, path, canonical_json({"spec_version": spec_version, "body": body}))
    return body


def table_stage(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A resume point for tables: read if a committed table is there, else compute and write."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def open_run(spark: SparkSession, root: str, run_id: str) -> str:
    """The folder of a run, with its time of creation."""
    path = f"{root}/runs/{run_id}"
    if not path_exists(spark, f"{path}/run.json"):
        write_file(spark, f"{path}/run.json", canonical_json({"id": run_id, "created_at": datetime.now(timezone.utc).isoformat()}))
    return path


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The run of the latest creation, then of the largest id."""
    fs, p = filesystem(spark, f"{root}/runs/*/run.json")
    runs = [json.loads(read_file(spark, str(f.getPath()))) for f in fs.globStatus(p) or []]
    return max(runs, key=lambda r: (r["created_at"], r["id"]))["id"] if runs else None


#: Lines of a release's file: files stay small enough to be hashed whole.
LINES = 500_000


def write_release(records: DataFrame, provenance: DataFrame, failures: DataFrame, root: str, version: str, key: str, extra: dict[str, str] | None = None) -> str:
    """Write dataset and provenance and a manifest of hashes; refuse a failed gate and an existing version.

    Both come from one frame in order of ``key``: line i of a dataset file belongs to line i of the provenance file of the same
    number, which names its index and the hash of the record. ``extra``: further small files, by name. All is written beside
    its place and renamed at the end."""
    if not failures.isEmpty():
        raise ReleaseError("the gate has not passed")
    if "/" in version or version.startswith(".") or not version.strip():
        raise ReleaseError(f"{version!r} is no name of a version")
    spark = records.sparkSession
    target = f"{root}/{version}"
    if path_exists(spark, target):
        raise ReleaseError(f"release {version} exists and is never overwritten")
    tmp = f"{root}/.{version}-{uuid.uuid4().hex[:6]}.tmp"
    lines = records.select(F.col(key).alias("_key"), canonical_row(records).alias("_line"))
    prov = provenance.select(F.col(key).alias("_pkey"), F.struct(*[F.col(f"`{c}`") for c in sorted(provenance.columns) if c != key]).alias("_prov"))
    both = numbered(lines.join(prov, F.col("_key") == F.col("_pkey"), "left"), "_key", name="_index")
    made = F.to_json(F.struct(F.col("_index").alias("index"), F.col("_prov").alias("provenance"), F.concat(F.lit("sha256:"), F.sha2(F.concat("_line", F.lit("\n")), 256)).alias("record_sha256")))
    fs, p = filesystem(spark, tmp)
    fs.setWriteChecksum(False)  # on a local disk too, the manifest's hashes are what files are held against
    try:
        for name, column in (("dataset", F.col("_line")), ("provenance", made)):
            both.select(column.alias("value")).write.option("maxRecordsPerFile", LINES).text(f"{tmp}/{name}")
        for name, text in (extra or {}).items():
            write_file(spark, f"{tmp}/{name}", text)
    finally:
        fs.setWriteChecksum(True)
    manifest = {r["path"]: r["sha"] for r in file_hashes(spark, tmp).collect()}  # a row per file
    write_file(spark, f"{tmp}/manifest.json", canonical_json({"version": version, "records": both.count(), "files": manifest}))
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise ReleaseError(f"release {version} could not be put in place")
    return target


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha`` of a release's files but its manifest, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_extract("path", ".*/" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    rows = files.select(relative.alias("path"), F.sha2("content", 256).alias("sha"))
    return rows.filter("path <> 'manifest.json' and not startswith(element_at(split(path, '/'), -1), '_') and not startswith(element_at(split(path, '/'), -1), '.')")


def verify_release(spark: SparkSession, path: str) -> list[str]:
    """Files whose hash differs from the manifest, or that are missing or unknown."""
    want = json.loads(read_file(spark, f"{path}/manifest.json"))["files"]
    have = {r["path"]: r["sha"] for r in file_hashes(spark, path).collect()}
    return sorted(k for k in want.keys() | have.keys() if want.get(k) != have.get(k))


PROVENANCE = "_provenance"


def attach(records: DataFrame, provenance: DataFrame, key: str) -> DataFrame:
    """Records with their provenance (key and other columns) as one private struct; a record that has one already raises."""
    if PROVENANCE in records.columns:
        raise ReleaseError(f"records already have {PROVENANCE}")
    packed = provenance.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in provenance.columns if c != key]).alias(PROVENANCE))
    return records.join(packed, records[key] == packed["_key"], "left").drop("_key")


def split(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inverse: bare records, and their provenance by key."""
    if PROVENANCE not in records.columns:
        raise ReleaseError(f"records have no {PROVENANCE}")
    return records.drop(PROVENANCE), records.select(key, f"{PROVENANCE}.*")


def endpoints(runs: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sorted distinct models of runs and of provenance rows (model)."""
    return runs.select("model").unionByName(provenance.select("model")).filter("model is not null").distinct().orderBy("model")


def tool_rollup(traces: DataFrame) -> DataFrame:
    """``tool, calls, sensitivities``."""
    return traces.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sort_array(F.collect_set("sensitivity")).alias("sensitivities"))


def shortfall(coverage: DataFrame, failures: DataFrame) -> dict:
    """What a release lacks: missing records by cell and failed thresholds; plans and gates are small."""
    return {"short_cells": {r["cell_id"]: r["missing"] for r in coverage.filter("missing > 0").select("cell_id", "missing").collect()}, "failures": [r.asDict() for r in failures.collect()]}


def dataset_card(title: str, metrics: dict, short: dict) -> str:
    lines = [f"# {title}", "", "| metric | value |", "|---|---|", *[f"| {k} | {'not measured' if v is None else v} |" for k, v in sorted(metrics.items())]]
    if short:
        lines += ["", "Cells short of their quota: " + ", ".join(f"{c} ({n})" for c, n in sorted(short.items()))]
    return "\n".join(lines) + "\n"


def governance_report(profile, violations: int | None, codes: DataFrame, models: DataFrame, tools: DataFrame, failures: DataFrame, held_out_checked: bool, seeds_sent_to: list[str] = ()) -> dict:
    """What a release says of its governance: the rules in force and their documented exceptions, violations, which models and
    tools saw data, and whether held-out items were checked. Its tables have a row per code, model and tool."""
    return {
        "rules": {"pii": sorted(profile.pii_rules | {n for n, _ in profile.pii_patterns}), "toxicity": sorted(profile.toxicity - profile.toxicity_exceptions), "secrets": sorted(profile.secrets), "denied": sorted(profile.deny), "allowed": sorted(profile.allow)},
        "exceptions": [{"rule": r, "reason": why} for r, why in profile.exceptions],
        "violations": violations,
        "codes": {r["code"]: r["n"] for r in codes.groupBy("code").agg(F.sum("n").alias("n")).collect()},
        "data_endpoints": [r["model"] for r in models.collect()],
        "tools": [r.asDict() for r in tools.orderBy("tool").collect()],
        "gate_failures": [r["metric"] for r in failures.select("metric").distinct().orderBy("metric").collect()],
        "held_out_checked": held_out_checked,
        "seeds_sent_to": sorted(seeds_sent_to),
    }


# ---------------------------------------------------------------------------- review


def queue_items(submitted: DataFrame) -> DataFrame:
    """Submitted items once each, by content hash, in order of first submission (n, content)."""
    return submitted.withColumn("item_id", F.sha2("content", 256)).groupBy("item_id").agg(F.min_by("content", "n").alias("content"), F.min("n").alias("n")).orderBy("n")


def resolve(items: DataFrame, resolutions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``resolutions`` (item_id, action, label, n) with those ``decisions`` that say something new: a decision equal to the
    item's last one is no second one. Unknown items and actions raise."""
    if not decisions.join(items.select("item_id"), "item_id", "left_anti").isEmpty():
        raise ValueError("a decision names an item that was never submitted")
    if not decisions.filter("action is null or action not in ('accept', 'reject', 'relabel') or (action = 'relabel' and label is null)").isEmpty():
        raise ValueError("a decision is accept, reject, or relabel with a label")
    last = resolutions.groupBy("item_id").agg(F.max_by(F.struct("action", "label"), "n").alias("_last"))
    new = decisions.join(last, "item_id", "left").filter(~F.struct("action", "label").eqNullSafe(F.col("_last"))).select(*resolutions.columns)
    return resolutions.unionByName(new)


def pending(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    return items.join(resolutions.select("item_id"), "item_id", "left_anti")


def gold(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Accepted and relabelled items (resolutions: item_id, action, label, n) under their last decision; rejected ones are left out."""
    last = resolutions.groupBy("item_id").agg(F.max_by(F.struct("action", "label"), "n").alias("r"))
    return items.join(last, "item_id").filter(F.col("r.action").isin("accept", "relabel")).select("item_id", "content", F.when(F.col("r.action") == "relabel", F.col("r.label")).alias("label"))
