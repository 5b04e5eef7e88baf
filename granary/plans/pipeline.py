"""A run from plan to release: cells, rounds of generation and validation, ordered settling, metrics, gate, release.

Every step leaves a committed table in the run's folder, so a run that broke off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import generate, metrics, planning, validate
from granary.plans.spec import TaskSpec
from granary.plans.tracing import Tracer
from granary.session import cut, path_exists
from granary.sources import store
from granary.streaming.dedup import settle_batch

DROPS = "slot bigint, cell_id string, layer string, codes array<string>, attempts int, hard boolean, history array<struct<layer:string,codes:array<string>>>"
ACCEPTED = "slot bigint, cell_id string, reply string, repair_count int, failed_layers array<string>, text string, round int"


@dataclass
class Pipeline:
    """``spec`` names axes, balance, thresholds and budget; ``layers`` gives the cascade for rows with slot, cell_id, reply and text;
    ``text_of`` reads a reply's text (by default its ``text`` field)."""

    spark: SparkSession
    root: str
    spec: TaskSpec
    backend: object
    layers: Callable[[DataFrame], list[validate.Layer]] = lambda df: []
    text_of: Callable[[DataFrame], object] = lambda df: F.get_json_object("reply", "$.text")
    prefix: str = "Write one record as a JSON object with the field text."
    threshold: float = 0.8
    tracer: Tracer = field(default_factory=Tracer)

    def plan(self) -> DataFrame:
        """The cells with quotas, built once."""
        size = int(self.spec.body.get("budget", {}).get("target_size", 0))
        return store.table_stage(self.spark, f"{self.root}/plan-{self.spec.version[:12]}", lambda: planning.build_plan(self.spark, self.spec.body, size)[0])

    def _path(self, run_id: str, name: str, n: int) -> str:
        return f"{self.root}/runs/{run_id}/{name}/round={n}"

    def _rounds(self, run_id: str) -> int:
        n = 0
        while path_exists(self.spark, self._path(run_id, "accepted", n) + "/_SUCCESS"):
            n += 1
        return n

    def accepted(self, run_id: str) -> DataFrame:
        done = self._rounds(run_id)
        return self.spark.read.parquet(*[self._path(run_id, "accepted", n) for n in range(done)]) if done else self.spark.createDataFrame([], ACCEPTED)

    def drops(self, run_id: str) -> DataFrame:
        done = self._rounds(run_id)
        return self.spark.read.parquet(*[self._path(run_id, "drops", n) for n in range(done)]) if done else self.spark.createDataFrame([], DROPS)

    def _validate(self, made: DataFrame) -> DataFrame:
        rows = made.withColumn("reply", T.json_object(F.col("reply"))).withColumn("text", self.text_of(made))
        rows = rows.withColumn("text", T.strip(self.text_of(rows)))
        parsed = validate.Layer("L1", validate.issue(F.col("error").isNull() & (F.col("reply").isNull() | F.coalesce(F.col("text") == "", F.lit(True))), "unparseable", "reply"))
        own = self.layers(rows)
        if own and own[0].name == "L1":
            parsed, own = validate.Layer("L1", validate.first_of(parsed.issues, own[0].issues)), own[1:]
        return validate.run_cascade(rows, [parsed, *own], "slot")

    def run(self, run_id: str, max_rounds: int = 3) -> str:
        """Rounds until every cell is full, a round brings nothing, or they are over; goes on with the first round that is
        not committed. Returns ``complete``, ``stalled`` or ``max_rounds``."""
        store.open_run(self.spark, self.root, run_id)
        cells = self.plan()
        tries = int(self.spec.body.get("budget", {}).get("repair_tries", 2))
        seed = int(self.spec.version[:8], 16)
        for n in range(max_rounds):
            cover = metrics.coverage(cells, self.accepted(run_id))
            short = cells.drop("quota").join(cover.filter("missing > 0").select("cell_id", F.col("missing").alias("quota")), "cell_id")
            if short.isEmpty():
                return "complete"
            if n < self._rounds(run_id):
                continue
            with self.tracer.span(f"round {n}", inputs={"run": run_id}) as span:
                got = self._round(run_id, n, short, seed, tries)
                span.end({"accepted": got})
            if got == 0:
                return "stalled"
        left = metrics.coverage(cells, self.accepted(run_id)).filter("missing > 0")
        return "complete" if left.isEmpty() else "max_rounds"

    def _round(self, run_id: str, n: int, short: DataFrame, seed: int, tries: int) -> int:
        slots = planning.candidates(planning.schedule(short), seed + n)
        params = short.select("cell_id", F.to_json("params").alias("_params"))
        slots = slots.join(F.broadcast(params), "cell_id").select((F.col("slot") + n * (1 << 40)).alias("slot"), "cell_id", F.concat(F.lit("Cell: "), F.col("_params"), F.lit("\nSeed: "), F.col("seed").cast("string")).alias("cell"))
        wave = generate.run_wave(slots, self.backend, self._validate, self.prefix, tries)
        ok = wave.accepted.withColumn("text", T.strip(self.text_of(wave.accepted)))
        old = self.accepted(run_id).select(F.col("slot").alias("id"), "text") if n else None
        kept = settle_batch(ok.select(F.col("slot").alias("id"), "text"), old, self.threshold).select(F.col("id").alias("slot"))
        beaten = ok.join(kept, "slot", "left_anti").select("slot", "cell_id", F.lit("L4").alias("layer"), F.array(F.lit("near_duplicate")).alias("codes"), (F.col("repair_count") + 1).alias("attempts"), F.lit(True).alias("hard"), F.array(F.struct(F.lit("L4").alias("layer"), F.array(F.lit("near_duplicate")).alias("codes"))).alias("history"))
        wave.drops.select(*beaten.columns).unionByName(beaten).write.mode("overwrite").parquet(self._path(run_id, "drops", n))
        ok.join(kept, "slot", "left_semi").withColumn("round", F.lit(n)).write.mode("overwrite").parquet(self._path(run_id, "accepted", n))  # last: it commits the round
        return self.spark.read.parquet(self._path(run_id, "accepted", n)).count()

    def evaluate(self, run_id: str, **measured) -> DataFrame:
        """The metrics report of a run; ``measured`` is what :func:`granary.operators.metrics.report` takes besides."""
        rows = self.accepted(run_id).select(F.col("slot").alias("id"), "cell_id", "text", F.get_json_object("reply", "$.label").alias("label"), "repair_count", F.transform("failed_layers", lambda x, i: F.struct(x.alias("layer"), F.lit("fail_repairable").alias("outcome"), i.alias("attempt"))).alias("layer_results"))
        return metrics.report(rows, self.drops(run_id), self.plan(), **measured)

    def gate(self, report: DataFrame, waive: tuple[str, ...] = ()) -> DataFrame:
        """The spec's thresholds that a report fails."""
        return metrics.gate(metrics.gate_values(report), dict(self.spec.body.get("thresholds", {})), waive)

    def release(self, run_id: str, version: str, waive: tuple[str, ...] = (), **measured) -> str:
        """Write a release of the run's accepted records, or raise where the gate fails."""
        report = cut(self.evaluate(run_id, **measured))
        failures = self.gate(report, waive)
        whole = report.filter("is_total").drop("cell_id", "is_total").first().asDict()
        short = {r["cell_id"]: r["missing"] for r in metrics.coverage(self.plan(), self.accepted(run_id)).filter("missing > 0").collect()}
        rows = self.accepted(run_id)
        card = store.dataset_card(f"{self.spec.body['task']['name']} {version}", whole, short)
        return store.write_release(rows.select("slot", "cell_id", "reply"), rows.select("slot", "round", "repair_count", "failed_layers"), failures, f"{self.root}/releases", version, "slot", {"card.md": card})
