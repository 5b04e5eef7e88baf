"""Coverage plans: axes, their cross product, share fitting, apportionment, scheduling order and seeds."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import numbered

#: The levels of the cognitive axis, lowest first.
BLOOM = ["Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"]


def value_id(v: object) -> str:
    """A string as it is, any other value as JSON."""
    return v if isinstance(v, str) else json.dumps(v)


@dataclass
class Axis:
    name: str
    values: list
    weights: list[float] | None = None

    def shares(self) -> list[float]:
        w = self.weights or [1.0] * len(self.values)
        return [x / sum(w) for x in w]


def resolve_axes(spec: dict[str, dict], found: list[str] = ()) -> list[Axis]:
    """Axes of a plan's ``axes`` section: fixed values, cognitive levels, or keywords with found ones appended; weights hold only under ``weighted``."""
    out = []
    for name, a in spec.items():
        source = a.get("source", "fixed")
        values = list(BLOOM) if source == "bloom" and not a.get("values") else list(a.get("values", []))
        if source in ("keyword_expansion", "retrieval"):
            values = list(dict.fromkeys([*values, *found]))
        out.append(Axis(name, values, a.get("weights") if a.get("weighted") else None))
    return out


def cross(spark: SparkSession, axes: list[Axis]) -> DataFrame:
    """``cell_id, pos, params, share``: all combinations, last axis fastest, each with the product of its shares."""
    df = None
    for n, axis in enumerate(axes):
        one = spark.createDataFrame([(k, value_id(v), s) for k, (v, s) in enumerate(zip(axis.values, axis.shares()))], f"o{n} int, v{n} string, s{n} double")
        df = one if df is None else df.crossJoin(F.broadcast(one))  # axes are a spec's own short lists
    pos, share = F.lit(0), F.lit(1.0)
    for n, axis in enumerate(axes):
        pos, share = pos * len(axis.values) + F.col(f"o{n}"), share * F.col(f"s{n}")
    params = F.create_map(*[x for n, a in enumerate(axes) for x in (F.lit(a.name), F.col(f"v{n}"))])
    return df.select(F.concat_ws("|", *[f"v{n}" for n in range(len(axes))]).alias("cell_id"), pos.cast("int").alias("pos"), params.alias("params"), share.alias("share"))


def apportion(cells: DataFrame, total: int, share: str = "share", order: str = "pos", by: list[str] | None = None) -> DataFrame:
    """Adds ``quota``: whole numbers that sum to ``total`` (in each group of ``by``), by largest remainder, ties in plan order."""
    by = by or []
    sums = cells.groupBy(*by).agg(F.sum(share).alias("_sum"))
    df = cells.join(F.broadcast(sums), by) if by else cells.crossJoin(F.broadcast(sums))  # a row per group of a plan
    df = df.withColumn("_exact", F.col(share) / F.col("_sum") * total).withColumn("_floor", F.floor(F.round("_exact", 9)))
    rest = F.round(F.col("_exact") - F.col("_floor"), 9).desc()
    if by:
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(rest, order)))
    else:
        df = numbered(df, rest, order, name="_rank").withColumn("_rank", F.col("_rank") + 1)
    floors = df.groupBy(*by).agg(F.sum("_floor").alias("_floors"))
    df = df.join(F.broadcast(floors), by) if by else df.crossJoin(F.broadcast(floors))
    return df.withColumn("quota", (F.col("_floor") + (F.col("_rank") <= F.lit(total) - F.col("_floors")).cast("bigint")).cast("bigint")).drop("_sum", "_exact", "_floor", "_rank", "_floors")


class PlanError(ValueError):
    """A plan whose targets no valid cell can fill."""


def fit_shares(cells: list[dict], targets: dict[str, dict[str, float]], rounds: int = 200, close: float = 1e-12) -> list[float]:
    """Shares of kept cells scaled, axis by axis, until each balanced axis has its target marginals (iterative proportional
    fitting); an unlisted value has target 0, and a target that no cell with a share can fill raises. A plan's cells are few,
    so this runs on the driver."""
    share = [c["share"] for c in cells]
    for axis, want in targets.items():
        for v, t in want.items():
            if t > 0 and sum(s for c, s in zip(cells, share) if c["params"].get(axis) == v) <= 0:
                raise PlanError(f"{axis}: {v!r} has the target {t}, but no valid cell")
    total = sum(share)
    share = [s / total for s in share] if total else share
    for _ in range(rounds):
        worst = 0.0
        for axis, want in targets.items():
            marginal: dict[str, float] = {}
            for c, s in zip(cells, share):
                v = c["params"].get(axis)
                marginal[v] = marginal.get(v, 0.0) + s
            worst = max([worst, *(abs(m - want.get(v, 0.0)) for v, m in marginal.items())])
            share = [s * (want.get(v, 0.0) / marginal[v]) if marginal[v] else 0.0 for s, v in ((s, c["params"].get(axis)) for c, s in zip(cells, share))]
        if worst < close:
            break
    return share


def filter_valid(cells: list[dict], constraint) -> tuple[list[dict], list[dict]]:
    """Kept cells, and dropped ones with the reason; ``constraint`` returns params or None, or raises with a reason."""
    kept, dropped = [], []
    for c in cells:
        try:
            ok, why = constraint(c) is not None, "constraint"
        except ValueError as e:
            ok, why = False, str(e)
        (kept if ok else dropped).append(c if ok else {**c, "reason": why})
    return kept, dropped


def label_counts(cells: DataFrame, axis: str) -> DataFrame:
    """``value, quota``: planned records by value of an axis, cells that lack the axis under null."""
    return cells.select(F.try_element_at("params", F.lit(axis)).alias("value"), "quota").groupBy("value").agg(F.sum("quota").alias("quota"))


def schedule(cells: DataFrame) -> DataFrame:
    """``slot, cell_id, i``: the order in which a scheduler that always serves the cell of lowest fill, then most open slots, then
    plan order fills all quotas when nothing is rejected. Cell i's k-th slot has the key (k / quota, k - quota, pos), so one
    sort by ranges gives the order."""
    slots = cells.filter("quota > 0").select("cell_id", "pos", (F.col("quota")).alias("_q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota").cast("bigint") - 1)).alias("i"))
    slots = slots.withColumns({"_fill": F.col("i") / F.col("_q"), "_open": F.col("i") - F.col("_q")})
    return numbered(slots, "_fill", "_open", "pos").select("slot", "cell_id", "i")


def drawn(df: DataFrame, n: int, *keys: str, seed: str = "") -> DataFrame:
    """A sample of exactly ``n`` rows without replacement (all, if there are fewer): those of the smallest hashes of their
    keys, so the same however rows are partitioned; equal keys share a place in the order."""
    return df.withColumn("_h", F.xxhash64(*keys, F.lit(seed))).orderBy("_h", *keys).limit(n).drop("_h")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[k.cast("string") for k in keys]), 11) / float(1 << 53)


def choose(u: Column, weights: dict[str, float]) -> Column:
    """The value whose part of [0, total weight) holds ``u``; values of no weight are never drawn."""
    total, upto, out = sum(weights.values()), 0.0, None
    if total <= 0 or min(weights.values()) < 0:
        raise PlanError("weights must be positive together, none negative")
    some = [(v, w) for v, w in weights.items() if w > 0]
    for v, w in some[:-1]:
        upto += w / total
        out = F.when(u < upto, F.lit(v)) if out is None else out.when(u < upto, F.lit(v))
    last = F.lit(some[-1][0])
    return last if out is None else out.otherwise(last)


def conditional_sample(slots: DataFrame, fields: list[dict], seed: str = "0", key: str = "slot") -> DataFrame:
    """Slots with one column per field, drawn one after the other: a field's weights may depend on what stands before it.

    A field has ``name``; ``weights`` by value, or ``given`` (a column name) with ``by``: weights for each of its values; a
    ``when`` condition (SQL) outside which it is null. A slot that has the column already keeps its value where that is
    allowed; where it is not, or where ``given`` has a value without weights, ``valid`` is false. Draws depend on seed, slot
    and field only, so they are the same however slots are partitioned, in one projection."""
    out = slots.withColumn("valid", F.lit(True))
    for f in fields:
        name, u = f["name"], uniform(f"{seed}:{f['name']}", F.col(key))
        if "given" in f:
            drawn_, allowed = F.lit(None).cast("string"), F.lit(False)
            for value, weights in f["by"].items():
                hit = F.col(f["given"]).cast("string").eqNullSafe(F.lit(value))
                drawn_ = F.when(hit, choose(u, weights)).otherwise(drawn_)
                if name in slots.columns:
                    allowed = F.when(hit, F.col(name).isin([v for v, w in weights.items() if w > 0])).otherwise(allowed)
        else:
            drawn_ = choose(u, f["weights"])
            allowed = F.col(name).isin([v for v, w in f["weights"].items() if w > 0]) if name in slots.columns else None
        on = F.expr(f["when"]) if "when" in f else F.lit(True)
        if name in slots.columns:
            out = out.withColumn("valid", F.col("valid") & (~on | F.col(name).isNull() | F.coalesce(allowed, F.lit(False))))
            drawn_ = F.coalesce(F.col(name), drawn_)
        value = F.when(F.coalesce(on, F.lit(False)), drawn_)
        out = out.withColumn(name, value).withColumn("valid", F.col("valid") & (~F.coalesce(on, F.lit(False)) | F.col(name).isNotNull()))
    return out


def build_plan(spark: SparkSession, spec: dict, target: int, found: list[str] = (), constraint=None) -> tuple[DataFrame, list[dict]]:
    """Cells with quotas (cell_id, pos, params, share, quota) of a spec's axes and balance, and the cells that a constraint
    dropped, with reasons: cross, filter, fit shares, apportion."""
    axes = resolve_axes(spec["axes"], found)
    cells = [{"cell_id": r["cell_id"], "pos": r["pos"], "params": dict(r["params"]), "share": r["share"]} for r in cross(spark, axes).orderBy("pos").collect()]
    kept, dropped = filter_valid(cells, constraint) if constraint else (cells, [])
    if not kept:
        raise PlanError("no combination of the axes is valid")
    shares = fit_shares(kept, spec.get("balance", {}))
    rows = [(c["cell_id"], k, c["params"], float(s)) for k, (c, s) in enumerate(zip(kept, shares))]
    return apportion(spark.createDataFrame(rows, "cell_id string, pos int, params map<string,string>, share double"), target), dropped


def candidates(slots: DataFrame, run_seed: int) -> DataFrame:
    """Adds ``seed``, from the run's seed, the cell and the index in the cell: the same however the run is split."""
    from granary.functions.text import candidate_seed

    return slots.withColumn("seed", candidate_seed(F.lit(str(run_seed)), F.col("cell_id"), F.col("i").cast("string")))


class SchedulerError(ValueError):
    pass


@dataclass
class Scheduler:
    """The state machine for runs with rejections: lowest (accepted + in flight) / quota first, caps on attempts, a budget."""

    quotas: dict[str, int]
    budget: int
    attempts_per_quota: float = 3.0
    accepted: dict[str, int] = field(default_factory=dict)
    attempts: dict[str, int] = field(default_factory=dict)
    flying: dict[str, int] = field(default_factory=dict)
    spent: int = 0

    def stalled(self, cell: str) -> bool:
        return self.attempts.get(cell, 0) >= math.ceil(self.quotas[cell] * self.attempts_per_quota)

    def next_cell(self) -> str | None:
        if self.spent + sum(self.flying.values()) >= self.budget:
            return None
        best, key = None, None
        for pos, (c, q) in enumerate(self.quotas.items()):
            used = self.accepted.get(c, 0) + self.flying.get(c, 0)
            if used >= q or self.stalled(c):
                continue
            k = (used / q, used - q, pos)
            if key is None or k < key:
                best, key = c, k
        if best is not None:
            self.flying[best] = self.flying.get(best, 0) + 1
            self.attempts[best] = self.attempts.get(best, 0) + 1
        return best

    def settle(self, cell: str, ok: bool, tries: int = 1) -> None:
        if not self.flying.get(cell):
            raise SchedulerError(f"nothing in flight for {cell}")
        self.flying[cell] -= 1
        self.spent += tries
        if ok:
            self.accepted[cell] = self.accepted.get(cell, 0) + 1

    def wave(self, size: int) -> list[str]:
        out = []
        while len(out) < size and (c := self.next_cell()) is not None:
            out.append(c)
        return out
