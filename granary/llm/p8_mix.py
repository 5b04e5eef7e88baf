"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.matching import category_key
from granary.llm.thresholds import MAX_BUDGETS, find_thresholds, hash63, histogram
from granary.session import cut

REPORT = "mix_id int, source string, target_weight double, max_repeats int, target_tokens double, available_tokens bigint, whole_copies bigint, hash_below bigint, mixed_tokens bigint, actual_share double, is_short boolean"


@dataclass
class Mix:
    report: DataFrame  #: one row per mix and source
    rows: DataFrame  #: mix_id, source, doc_id, copies, size


def mix_sources(docs: DataFrame, targets: DataFrame, seed: str = "mix") -> Mix:
    """Choose how often each document enters each mix.

    ``docs``: doc_id, text, source. ``targets``: mix_id, source, target_weight, max_repeats, total_tokens.
    A source's budget is total_tokens x target_weight. It gives as many whole copies of itself as fit (at most
    max_repeats), then the documents below a hash threshold once more. Sizes are summed by source and hash
    bucket; only the bucket where a budget ends is refined, and documents are then chosen by a filter.

    Sources match under :func:`category_key`; a null source belongs to none; a null text has size 1 (its end
    mark). A source without documents is short; a null weight or total counts as 0, null max_repeats as 1.
    Repeated rows each count. Other columns of ``docs`` are ignored. Documents with one doc_id share a hash.
    """
    goals = targets.select("mix_id", "source", "target_weight", "max_repeats", "total_tokens").limit(MAX_BUDGETS + 1).withColumn("source_key", category_key(F.col("source"))).collect()
    if len(goals) > MAX_BUDGETS:
        raise ValueError("the target table is larger than a target table may be")
    spark = docs.sparkSession
    keys = spark.createDataFrame([(k,) for k in sorted({g["source_key"] for g in goals if g["source_key"] is not None})], "source_key string")
    slim = cut(
        docs.select(F.col("doc_id"), category_key(F.col("source")).alias("source_key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), hash63(F.col("doc_id"), seed=seed).alias("h"))
        .join(F.broadcast(keys), "source_key", "left_semi")
    )
    first = histogram(slim, ["source_key"]).collect()  # sources named in targets x 4096 rows at most
    available: dict[str, int] = {}
    for r in first:
        available[r["source_key"]] = available.get(r["source_key"], 0) + r["size"]
    lines, budgets = [], []
    for g in goals:
        have, most = available.get(g["source_key"], 0), max(0, 1 if g["max_repeats"] is None else g["max_repeats"])
        want = (g["total_tokens"] or 0) * (g["target_weight"] or 0.0)
        whole = min(most, math.floor(want / have)) if have else 0
        rest = want - whole * have if whole < most else 0
        lines.append([g, want, have, whole, most])
        budgets.append(((g["source_key"],), rest))
    cuts = find_thresholds(slim, ["source_key"], budgets, first=first)
    chosen, total = [], {}
    for (g, want, have, whole, most), c in zip(lines, cuts):
        below = c.below if c.budget > 0 else 0
        mixed = int(whole * have + (c.weight if c.budget > 0 else 0))
        total[g["mix_id"]] = total.get(g["mix_id"], 0) + mixed
        chosen.append((g["mix_id"], g["source"], g["target_weight"], g["max_repeats"], want, have, whole, below, mixed, have * most < want, g["source_key"]))
    report = spark.createDataFrame([(*x[:9], x[8] / total[x[0]] if total[x[0]] else None, x[9]) for x in chosen], REPORT)
    plan = spark.createDataFrame([(x[0], x[1], x[10], x[6], x[7]) for x in chosen], "mix_id int, source string, source_key string, whole bigint, below bigint")
    rows = (
        slim.join(F.broadcast(plan), "source_key")
        .withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("bigint"))
        .filter("copies > 0")
        .select("mix_id", "source", "doc_id", "copies", "size")
    )
    return Mix(report, rows)
