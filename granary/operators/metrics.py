"""Metrics of a run, overall (null cell) and per cell in one pass, and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tries(accepted: DataFrame, drops: DataFrame) -> DataFrame:
    """``cell_id, layer``: one row per try. An accepted record (cell_id, repair_count, failed ARRAY<STRUCT<attempt, layer>>) has one
    try per repair, failed at that attempt's first failing layer or at generation, and a passing one (null layer); a dropped one
    (cell_id, layer, attempts, history) its history, or its last layer for every attempt where the history is incomplete."""
    n = F.coalesce("repair_count", F.lit(0))
    failed = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.coalesce(F.try_element_at(F.filter(F.col("failed"), lambda f: f["attempt"] == a), F.lit(1))["layer"], F.lit("generate")))).otherwise(F.array().cast("array<string>"))
    ok = accepted.select("cell_id", F.explode(F.concat(failed, F.array(F.lit(None).cast("string")))).alias("layer"))
    return ok.unionByName(drop_tries(drops))


def drop_tries(drops: DataFrame) -> DataFrame:
    count = F.coalesce("attempts", F.lit(0))
    history = F.transform(F.coalesce("history", F.array().cast("array<struct<layer:string,codes:array<string>>>")), lambda h: h["layer"])
    return drops.select("cell_id", F.explode(F.when(F.size(history) == count, history).when(count > 0, F.array_repeat(F.col("layer"), count)).otherwise(F.array().cast("array<string>"))).alias("layer"))


def error_rates(all_tries: DataFrame) -> DataFrame:
    """``cell_id, is_total, layer, failed, tries, rate``: failures of each layer over all tries, overall and per cell."""
    sets = all_tries.groupingSets([["layer"], ["cell_id", "layer"]], "cell_id", "layer").agg(F.count(F.lit(1)).alias("failed"), F.grouping("cell_id").alias("is_total"))
    totals = all_tries.groupingSets([[], ["cell_id"]], "cell_id").agg(F.count(F.lit(1)).alias("tries"), F.grouping("cell_id").alias("is_total"))
    t = totals.select(F.col("cell_id").alias("c"), F.col("is_total").alias("g"), "tries")
    return sets.filter("layer is not null").join(t, F.col("cell_id").eqNullSafe(F.col("c")) & (F.col("is_total") == F.col("g"))).select("cell_id", (F.col("is_total") == 1).alias("is_total"), "layer", "failed", "tries", (F.col("failed") / F.col("tries")).alias("rate"))


def yields(accepted: DataFrame, all_tries: DataFrame) -> DataFrame:
    """``accepted, tries, yield``: accepted records over tries; null without tries."""
    a, t = accepted.agg(F.count(F.lit(1)).alias("accepted")), all_tries.agg(F.count(F.lit(1)).alias("tries"))
    return a.crossJoin(F.broadcast(t)).select("accepted", "tries", F.try_divide(F.col("accepted").cast("double"), F.col("tries")).alias("yield"))


def coverage(cells: DataFrame, accepted: DataFrame) -> DataFrame:
    """``cell_id, quota, accepted, fill, missing`` of every cell; a cell without quota is full."""
    have = accepted.groupBy("cell_id").agg(F.count(F.lit(1)).alias("accepted"))
    n = F.coalesce("accepted", F.lit(0))
    return cells.select("cell_id", "quota").join(have, "cell_id", "left").select("cell_id", "quota", n.alias("accepted"), F.when(F.col("quota") == 0, F.lit(1.0)).otherwise(n / F.col("quota")).alias("fill"), F.greatest(F.col("quota") - n, F.lit(0)).alias("missing"))


def coverage_summary(per_cell: DataFrame) -> DataFrame:
    return per_cell.agg(F.try_divide(F.sum("accepted").cast("double"), F.sum("quota")).alias("fill"), F.avg((F.col("fill") >= 1).cast("double")).alias("cells_at_quota"), F.min("fill").alias("min_cell_fill"), F.count_if(F.col("missing") > 0).alias("short_cells"))


def unknown_cells(accepted: DataFrame, cells: DataFrame) -> DataFrame:
    """Records of cells that are not in the plan; metrics need this to be empty."""
    return accepted.join(cells.select("cell_id"), "cell_id", "left_anti")


def balance(records: DataFrame, targets: DataFrame, axis: str) -> DataFrame:
    """``axis, value, target, actual, deviation`` over values that are targeted or seen; records (value) without a value are left out,
    and with no record at all actual and deviation are null."""
    counts = records.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    both = targets.select("value", "target").join(counts, "value", "full_outer").crossJoin(F.broadcast(total))
    actual = F.when(F.col("t") > 0, F.coalesce("n", F.lit(0)) / F.col("t"))
    return both.select(F.lit(axis).alias("axis"), "value", F.coalesce("target", F.lit(0.0)).alias("target"), actual.alias("actual"), F.abs(actual - F.coalesce("target", F.lit(0.0))).alias("deviation"))


def own_or_cell(own: Column, cell: Column) -> Column:
    """A record's own label before its cell's."""
    return F.coalesce(own, cell)


def drop_counts(drops: DataFrame) -> DataFrame:
    """``cell_id, layer, code, n``: drops by cell and layer (null code), by layer, and by code, as grouping sets told apart by ``level``."""
    by_layer = drops.groupingSets([["cell_id", "layer"], ["layer"]], "cell_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    one = by_layer.select(F.when(F.col("g") == 0, "cell_layer").otherwise("layer").alias("level"), "cell_id", "layer", F.lit(None).cast("string").alias("code"), "n")
    codes = drops.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(codes.select(F.lit("code").alias("level"), F.lit(None).cast("string").alias("cell_id"), F.lit(None).cast("string").alias("layer"), "code", "n"))


def per_record(total: Column, accepted: Column) -> Column:
    """Cost, tokens or seconds per accepted record; null where there is none or the total is unknown."""
    return F.try_divide(total.cast("double"), accepted)


def usage_totals(usage: DataFrame) -> DataFrame:
    """Sums by stage; a stage whose calls are all unpriced keeps a null cost."""
    return usage.groupBy("stage").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def fidelity(finals: DataFrame) -> DataFrame:
    """``judged, fidelity``: share of judged records (agreed, null where not judged) the judge agreed with; null with none."""
    return finals.agg(F.count("agreed").alias("judged"), F.avg(F.col("agreed").cast("double")).alias("fidelity"))


def residual_error(records: DataFrame, residuals: DataFrame, fallback: float) -> DataFrame:
    """``residual_error``: mean over records (label) of one minus the judge's precision for the label, ``fallback`` for unknown labels."""
    return records.join(F.broadcast(residuals), records["label"] == residuals["judged"], "left").agg(F.avg(F.coalesce("residual", F.lit(fallback))).alias("residual_error"))


def failed_tries(layer_results: Column) -> Column:
    """What :func:`tries` needs of a record's layer results (layer, outcome, attempt): those that did not pass."""
    return F.transform(F.filter(layer_results, lambda r: r["outcome"] != "pass"), lambda r: F.struct(r["attempt"].cast("int").alias("attempt"), r["layer"].alias("layer")))


def final_judgement(layer_results: Column, repair_count: Column, layer: str = "L5") -> Column:
    """Whether a layer's last outcome at the final attempt is a pass; null where the layer did not judge that attempt."""
    own = F.filter(layer_results, lambda r: (r["layer"] == layer) & (F.coalesce(r["attempt"], F.lit(0)) == F.coalesce(repair_count, F.lit(0))))
    return F.try_element_at(own, F.lit(-1))["outcome"] == "pass"


def planned_targets(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``axis, value, quota, target`` (per ``by``): planned records by value of every axis, and their share of the axis; null
    shares where an axis has no quota. Only cells that carry an axis count in it."""
    by = by or []
    values = cells.select(*by, "quota", F.explode("params").alias("axis", "value")).groupBy(*by, "axis", "value").agg(F.sum("quota").alias("quota"))
    totals = values.groupBy(*by, "axis").agg(F.sum("quota").alias("_all"))
    return values.join(totals, [*by, "axis"]).select(*by, "axis", "value", "quota", F.try_divide(F.col("quota").cast("double"), F.col("_all")).alias("target"))


def _both(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates overall (null cell, ``is_total``) and per cell, in one pass."""
    return df.groupingSets([[], ["cell_id"]], "cell_id").agg(*aggregates, F.grouping("cell_id").alias("_g")).withColumn("is_total", F.col("_g") == 1).drop("_g")


def fidelity_by_cell(judged: DataFrame) -> DataFrame:
    """``cell_id, is_total, judged, fidelity`` of ``judged`` (cell_id, agreed; null where not judged)."""
    return _both(judged, F.count("agreed").alias("judged"), F.avg(F.col("agreed").cast("double")).alias("fidelity"))


def governance_counts(flags: DataFrame) -> DataFrame:
    """``cell_id, is_total, violations``: records (cell_id, codes) with a code at all."""
    return _both(flags, F.count_if(F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0).alias("violations"))


def governance_codes(flags: DataFrame) -> DataFrame:
    """``cell_id, is_total, code, n``: issues by code, overall and per cell; a record may have several of one code."""
    one = flags.select("cell_id", F.explode("codes").alias("code"))
    sets = one.groupingSets([["code"], ["cell_id", "code"]], "cell_id", "code").agg(F.count(F.lit(1)).alias("n"), F.grouping("cell_id").alias("g"))
    return sets.select("cell_id", (F.col("g") == 1).alias("is_total"), "code", "n")


def overlap_maxima(scores: DataFrame) -> DataFrame:
    """``cell_id, is_total, source, overlap``: highest similarity by source (cell_id, source, score), overall and per cell."""
    sets = scores.groupingSets([["source"], ["cell_id", "source"]], "cell_id", "source").agg(F.max("score").alias("overlap"), F.grouping("cell_id").alias("g"))
    return sets.select("cell_id", (F.col("g") == 1).alias("is_total"), "source", "overlap")


def report(accepted: DataFrame, drops: DataFrame, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, residuals: DataFrame | None = None, fallback: float | None = None, kappa: float | None = None, flags: DataFrame | None = None, overlaps: DataFrame | None = None, usage: dict[str, float | None] | None = None, entropy: float | None = None, with_diversity: bool = True) -> DataFrame:
    """Every release metric, one row overall (null cell, ``is_total``) and one per cell of the plan.

    ``accepted``: id, cell_id, text, label, repair_count, layer_results. ``drops``: cell_id, layer, attempts, history.
    ``cells``: cell_id, quota, params. ``targets``: shares by axis and value; without them the planned shares of labels.
    ``flags``: cell_id, codes of each accepted record, ``overlaps``: cell_id, source, score; without them governance and
    overlap are not measured, nor is diversity with ``with_diversity`` off. What is not measured is null, never 0. Records of cells that the plan lacks raise."""
    from granary.operators import diversity

    if unknown := [r["cell_id"] for r in unknown_cells(accepted, cells).select("cell_id").distinct().limit(20).collect()]:
        raise ValueError(f"accepted records name cells that the plan lacks: {unknown}")
    spark = accepted.sparkSession
    base = cells.select("cell_id", F.lit(False).alias("is_total")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("cell_id"), F.lit(True).alias("is_total")))
    key = lambda df: df.withColumn("_k", F.when(F.col("is_total"), F.lit("")).otherwise(F.concat(F.lit("="), F.col("cell_id")))).drop("cell_id", "is_total")
    out = base.withColumn("_k", F.when(F.col("is_total"), F.lit("")).otherwise(F.concat(F.lit("="), F.col("cell_id"))))

    rows = accepted.select("cell_id", "label", final_judgement(F.col("layer_results"), F.col("repair_count")).alias("agreed"), "repair_count", failed_tries(F.col("layer_results")).alias("failed"))
    counts = _both(rows, F.count(F.lit(1)).alias("accepted"), F.count("agreed").alias("judged"), F.avg(F.col("agreed").cast("double")).alias("fidelity"))
    tried = _both(tries(rows, drops), F.count(F.lit(1)).alias("candidates"))
    out = out.join(key(counts), "_k", "left").join(key(tried), "_k", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("accepted", "judged", "candidates")}).withColumn("yield", F.try_divide(F.col("accepted").cast("double"), F.col("candidates")))

    per_cell = coverage(cells, accepted)
    whole = coverage_summary(per_cell).join(per_cell.agg(F.sum("quota").alias("quota")), how="cross").withColumn("is_total", F.lit(True)).withColumn("cell_id", F.lit(None).cast("string"))
    own = per_cell.select("cell_id", F.lit(False).alias("is_total"), "quota", "fill", F.col("fill").alias("min_cell_fill"), F.lit(None).cast("double").alias("cells_at_quota"), (F.col("missing") > 0).cast("bigint").alias("short_cells"))
    out = out.join(key(own.unionByName(whole.select(*own.columns))), "_k", "left")

    if targets is None:
        planned = {r["value"]: r["target"] for r in planned_targets(cells).filter("axis = 'label'").collect()}
        targets = {"label": planned} if planned else {}
    deviations = None
    params = cells.select("cell_id", "params")
    for axis, want in targets.items():
        of_cell = F.try_element_at("params", F.lit(axis))
        values = rows.join(F.broadcast(params), "cell_id").select("cell_id", (F.coalesce("label", of_cell) if axis == "label" else of_cell).alias("value"), of_cell.alias("_own")).filter("value is not null")
        wanted = spark.createDataFrame([(v, float(t)) for v, t in want.items()], "value string, target double")
        all_ = balance(values, wanted, axis).agg(F.max("deviation").alias("deviation")).select(F.lit(None).cast("string").alias("cell_id"), F.lit(True).alias("is_total"), "deviation")
        in_cell = values.filter("_own is not null").groupBy("cell_id").agg((1 - F.avg((F.col("value") == F.col("_own")).cast("double"))).alias("deviation")).select("cell_id", F.lit(False).alias("is_total"), "deviation")
        both = all_.unionByName(in_cell)
        deviations = both if deviations is None else deviations.unionByName(both)
    if deviations is None:
        out = out.withColumn("balance_max_deviation", F.lit(None).cast("double"))
    else:
        out = out.join(key(deviations.groupBy("cell_id", "is_total").agg(F.max("deviation").alias("balance_max_deviation"))), "_k", "left")

    if residuals is None:
        out = out.withColumn("residual_error", F.lit(None).cast("double"))
    else:
        with_residual = rows.join(F.broadcast(residuals), rows["label"] == residuals["judged"], "left").select("cell_id", F.coalesce("residual", F.lit(fallback)).alias("r"))
        out = out.join(key(_both(with_residual, F.avg("r").alias("residual_error"))), "_k", "left")
    if flags is None:
        out = out.withColumn("governance_violations", F.lit(None).cast("bigint"))
    else:
        out = out.join(key(governance_counts(flags).withColumnRenamed("violations", "governance_violations")), "_k", "left").withColumn("governance_violations", F.coalesce("governance_violations", F.lit(0)))
    if overlaps is None:
        out = out.withColumn("overlap_max", F.lit(None).cast("double"))
    else:
        top = overlap_maxima(overlaps.filter(F.col("source").isin(*OVERLAP_SOURCES)))
        out = out.join(key(top.groupBy("cell_id", "is_total").agg(F.max("overlap").alias("overlap_max"))), "_k", "left")

    if not with_diversity:
        out = out.withColumns({"distinct_2": F.lit(None).cast("double"), "self_bleu": F.lit(None).cast("double")})
        return _whole_figures(out, usage or {}, kappa, entropy)
    texts = accepted.select("id", "cell_id", "text")
    null_cell = lambda df: df.withColumn("cell_id", F.lit(None).cast("string")).withColumn("is_total", F.lit(True))
    distinct = null_cell(diversity.distinct_n(texts, 2)).unionByName(diversity.distinct_n(texts, 2, ["cell_id"]).withColumn("is_total", F.lit(False)))
    bleu = null_cell(diversity.self_bleu(texts)).unionByName(diversity.self_bleu(texts, by=["cell_id"]).withColumn("is_total", F.lit(False)))
    out = out.join(key(distinct), "_k", "left").join(key(bleu), "_k", "left")

    return _whole_figures(out, usage or {}, kappa, entropy)


def _whole_figures(out: DataFrame, usage: dict[str, float | None], kappa: float | None, entropy: float | None) -> DataFrame:
    """What is known of the whole only, beside the rest of a report."""
    only = lambda v: F.when(F.col("is_total"), F.lit(v).cast("double"))
    per = {f"{n}_per_record": F.when(F.col("is_total"), per_record(F.lit(usage.get(n)), F.col("accepted"))) for n in ("tokens", "cost", "seconds")}
    return out.withColumns({"kappa": only(kappa), "cluster_entropy": only(entropy)} | per).drop("_k")


# ---------------------------------------------------------------------------- gate

#: Thresholds and the metric each holds; those that are upper bounds; those that also hold per cell.
GATED = {
    "fidelity_min": "fidelity",
    "kappa_min": "kappa",
    "coverage_min_cell_fill": "min_cell_fill",
    "balance_tolerance": "balance_max_deviation",
    "distinct_n_min": "distinct_2",
    "self_bleu_max": "self_bleu",
    "semantic_diversity_min": "cluster_entropy",
    "residual_error_max": "residual_error",
    "governance_violations_max": "governance_violations",
    "overlap_max": "overlap_max",
    "cost_per_record_max": "cost_per_record",
}
UPPER = {"balance_tolerance", "self_bleu_max", "residual_error_max", "governance_violations_max", "overlap_max", "cost_per_record_max"}
PER_CELL = {"fidelity_min", "coverage_min_cell_fill", "balance_tolerance", "residual_error_max", "governance_violations_max", "overlap_max"}
GOVERNANCE = "governance_violations_max"
#: Sources of overlap that are gated.
OVERLAP_SOURCES = ("seed", "held_out")


class GateError(ValueError):
    """The gate was asked for what it must not do."""


def gate_values(metrics: DataFrame) -> DataFrame:
    """``cell_id, metric, value`` of a report, under the names of thresholds."""
    return unpivot(metrics.select("cell_id", *[F.col(m).alias(t) for t, m in GATED.items() if m in metrics.columns]), [t for t, m in GATED.items() if m in metrics.columns])


def gate(values: DataFrame, thresholds: dict[str, float | None], waive: tuple[str, ...] = ()) -> DataFrame:
    """``cell_id, metric, value, threshold, reason`` of every failed threshold over ``values`` (cell_id, metric, value; null
    cell: overall). An empty result is a pass; reason ``governance`` fails hard.

    Bounds are inclusive, unset thresholds hold nothing. Overall, an unmeasured metric fails as ``not_measured`` unless it
    is waived; a waived metric that was measured is held all the same. In a cell an unmeasured one is left to the whole.
    Governance has the limit 0 whatever is set, must be measured in every cell, and can't be waived."""
    if GOVERNANCE in waive:
        raise GateError("governance can't be waived")
    if unknown := (set(waive) | set(thresholds)) - set(GATED):
        raise GateError(f"unknown thresholds: {sorted(unknown)}")
    known = {k: v for k, v in thresholds.items() if v is not None} | {GOVERNANCE: 0.0}
    limits = values.sparkSession.createDataFrame([(k, float(v), k in UPPER, k in PER_CELL, k in waive) for k, v in known.items()], "metric string, threshold double, upper boolean, per_cell boolean, waived boolean")
    cells = values.select("cell_id").distinct()
    wanted = cells.join(F.broadcast(limits), F.col("cell_id").isNull() | F.col("per_cell"))
    v = values.select(F.col("cell_id").alias("c"), F.col("metric").alias("m"), "value")
    joined = wanted.join(v, F.col("cell_id").eqNullSafe(F.col("c")) & (F.col("metric") == F.col("m")), "left")
    missing = F.when(F.col("cell_id").isNull() & ~F.col("waived"), "not_measured")
    bad = (
        F.when(F.col("metric") == GOVERNANCE, F.when(F.col("value").isNull() | (F.col("value") > F.col("threshold")), "governance"))
        .when(F.col("value").isNull(), missing)
        .when(F.col("upper") & (F.col("value") > F.col("threshold")), "above_max")
        .when(~F.col("upper") & (F.col("value") < F.col("threshold")), "below_min")
    )
    return joined.withColumn("reason", bad).filter("reason is not null").select("cell_id", "metric", "value", "threshold", "reason")


def unpivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """``cell_id, metric, value`` of a wide metrics table."""
    return metrics.select("cell_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("cell_id", "x.metric", "x.value")
