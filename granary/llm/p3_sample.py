"""Samples that follow target shares, by divisor-method priorities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.matching import category_key
from granary.llm.thresholds import BITS, MAX_BUDGETS, find_thresholds, hash63, histogram
from granary.session import cut

REPORT = "plan_id int, tbl string, field string, category string, target_share double, min_rows bigint, sample_rows bigint, available bigint, wanted bigint, seats bigint, actual_share double, unmet boolean"


@dataclass
class Sample:
    report: DataFrame  #: one row per plan and category
    rows: DataFrame  #: plan_id, category, tbl, rec_key, rank, is_floor, priority


def divisor_seats(counts: list[int], shares: list[float], floors: list[int], n: int) -> list[int]:
    """Seats of each category when its floor records come first and then the smallest (rank - 0.5) / share.

    An exhausted category takes all it has, and its seats go to the others by the same priorities. Ties go to
    the category listed first. With more floor records than seats, floor records compete by priority.
    """
    low = [min(c, max(0, f)) for c, f in zip(counts, floors)]
    high = list(counts)
    if sum(low) >= n:
        low, high = [0] * len(low), low
    if sum(high) <= n:
        return [h if s > 0 or h == lo else lo for h, lo, s in zip(high, low, shares)]
    at = lambda x: [max(lo, min(h, math.floor(x * s + 0.5))) if s > 0 else lo for lo, h, s in zip(low, high, shares)]
    a, b = 0.0, 1.0
    while sum(at(b)) < n and b < 1e18:
        b *= 2
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if sum(at(m)) < n else (a, m)
    seats = at(a)
    order = sorted((i for i in range(len(seats)) if shares[i] > 0 and seats[i] < high[i]), key=lambda i: ((seats[i] + 0.5) / shares[i], i))
    for i in order:
        if sum(seats) >= n:
            break
        seats[i] += 1
    return seats


def sample_to_targets(tables: dict[str, tuple[DataFrame, str]], targets: DataFrame, seed: str = "sample") -> Sample:
    """One sample per plan of ``targets``: plan_id, tbl, field, category, target_share, min_rows, sample_rows.

    ``tables`` has, for each ``tbl``, its DataFrame and the natural key column; deliveries of one key are one
    record, that of the latest ``ingested_at`` (then largest ``seed_id``); a null key makes a record of each row.
    Fields joined by ``|`` are matched jointly. Values match under :func:`category_key`; any other value, and null,
    belongs to no category. The random order in a category is that of a hash of the key; a record's rank is the
    number of records in lower hash buckets plus its row_number within its bucket, so no category is ever
    gathered in one task. Priorities are (rank - 0.5) / target_share; floor records (rank <= min_rows) come first.
    A null or zero share gives priority to floor records only; null min_rows is 0. Empty tables give unmet targets.
    """
    goals = targets.select("plan_id", "tbl", "field", "category", "target_share", "min_rows", "sample_rows").limit(MAX_BUDGETS + 1).collect()
    if len(goals) > MAX_BUDGETS:
        raise ValueError("the target table is larger than a target table may be")
    spark = targets.sparkSession
    dims = targets.select("plan_id", "tbl", "field", "category", F.array_join(F.transform(F.split("category", r"\|"), category_key), "|").alias("cat_key"))
    parts = []
    for tbl, (df, key) in tables.items():
        fields = sorted({g["field"] for g in goals if g["tbl"] == tbl and g["field"]})
        cols = sorted({c for f in fields for c in f.split("|") if c in df.columns})
        if not cols:
            continue
        latest = (
            df.select(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00seed "), F.col("seed_id").cast("string"))).alias("rec_key"), F.struct("ingested_at", "seed_id").alias("at"), F.struct(*[category_key(F.col(c)).alias(c) for c in cols]).alias("v"))
            .groupBy("rec_key").agg(F.max_by("v", "at").alias("v"))
        )
        joint = [F.struct(F.lit(f).alias("field"), F.when(F.forall(F.array(*[F.col(f"v.{c}") for c in f.split("|")]), lambda x: x.isNotNull()), F.concat_ws("|", *[F.col(f"v.{c}") for c in f.split("|")])).alias("cat_key")) for f in fields if all(c in cols for c in f.split("|"))]
        parts.append(latest.select(F.lit(tbl).alias("tbl"), "rec_key", hash63(F.col("rec_key"), seed=seed).alias("h"), F.explode(F.array(*joint)).alias("j")).select("tbl", "rec_key", "h", "j.field", "j.cat_key"))
    if parts:
        matched = parts[0]
        for p in parts[1:]:
            matched = matched.unionByName(p)
    else:
        matched = spark.createDataFrame([], "tbl string, rec_key string, h bigint, field string, cat_key string")
    # dims is the target table itself, bounded above
    slim = cut(matched.join(F.broadcast(dims), ["tbl", "field", "cat_key"]).select("plan_id", "category", "tbl", "rec_key", "h", F.lit(1).cast("bigint").alias("size")))
    first = histogram(slim, ["plan_id", "category"]).collect()  # categories x 4096 rows at most
    counts: dict[tuple, int] = {}
    for r in first:
        counts[r["plan_id"], r["category"]] = counts.get((r["plan_id"], r["category"]), 0) + r["n"]
    plans: dict[int, list] = {}
    for g in goals:
        plans.setdefault(g["plan_id"], []).append(g)
    lines, budgets = [], []
    for plan, gs in sorted(plans.items(), key=lambda x: (x[0] is None, x[0])):
        have = [counts.get((plan, g["category"]), 0) for g in gs]
        n = max((g["sample_rows"] or 0) for g in gs)
        seats = divisor_seats(have, [g["target_share"] or 0.0 for g in gs], [g["min_rows"] or 0 for g in gs], n)
        took = sum(seats)
        for g, h, s in zip(gs, have, seats):
            wanted = max(g["min_rows"] or 0, math.floor(round((g["sample_rows"] or 0) * (g["target_share"] or 0.0), 6)))
            lines.append((plan, g["tbl"], g["field"], g["category"], g["target_share"], g["min_rows"], g["sample_rows"], h, wanted, s, s / took if took else None, h < wanted))
            budgets.append(((plan, g["category"]), s))
    report = spark.createDataFrame(lines, REPORT)
    cuts = find_thresholds(slim, ["plan_id", "category"], budgets, first=first)
    chosen = spark.createDataFrame([(*c.group, c.below, x[4] or 0.0, x[5] or 0) for c, x in zip(cuts, lines) if c.budget > 0], "plan_id int, category string, below bigint, share double, floor bigint")
    bucket = F.shiftrightunsigned(F.col("h"), 63 - BITS)
    before, seen = [], {}
    for r in sorted(first, key=lambda r: (str(r["plan_id"]), str(r["category"]), r["bucket"])):
        k = (r["plan_id"], r["category"])
        before.append((*k, r["bucket"], seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + r["n"]
    offsets = spark.createDataFrame(before, "plan_id int, category string, bucket bigint, before bigint")
    w = Window.partitionBy("plan_id", "category", "bucket").orderBy("h", "rec_key")
    rows = (
        slim.join(F.broadcast(chosen), ["plan_id", "category"])
        .filter("h < below")
        .withColumn("bucket", bucket)
        .join(offsets, ["plan_id", "category", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(w))
        .select("plan_id", "category", "tbl", "rec_key", "rank", (F.col("rank") <= F.col("floor")).alias("is_floor"), F.when(F.col("share") > 0, (F.col("rank") - 0.5) / F.col("share")).alias("priority"))
    )
    return Sample(report, rows)
