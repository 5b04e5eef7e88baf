"""Near-duplicate filtering of a stream: each micro-batch against what was accepted before, then in its own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.overlap import keep_first, similarity_join
from granary.session import path_exists


def settle_batch(batch: DataFrame, accepted: DataFrame | None, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Rows of ``batch`` (id, text) that are near neither an accepted row nor an earlier kept row of the batch.

    This equals checking row by row in order of id, as accepted rows have smaller ids. Texts without words are kept."""
    both = batch.select("id", "text") if accepted is None else accepted.select("id", "text").unionByName(batch.select("id", "text"))
    edges = similarity_join(both, threshold, k).select("a", "b")
    if accepted is not None:
        old = accepted.select("id", F.lit(True).alias("old"))
        marked = edges.join(old.withColumnRenamed("id", "a").withColumnRenamed("old", "old_a"), "a", "left").join(old.withColumnRenamed("id", "b").withColumnRenamed("old", "old_b"), "b", "left")
        beaten = marked.filter("(old_a is null) <> (old_b is null)").select(F.when(F.col("old_a"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
        batch = batch.join(beaten, "id", "left_anti")
        edges = marked.filter("old_a is null and old_b is null").select("a", "b").join(beaten.withColumnRenamed("id", "a"), "a", "left_anti").join(beaten.withColumnRenamed("id", "b"), "b", "left_anti")
    kept = keep_first(batch.select("id"), edges)
    return batch.join(kept.filter("kept").select("id"), "id", "left_semi")


def start(spark: SparkSession, source: str, corpus: str, checkpoint: str, threshold: float = 0.8, k: int = 5) -> StreamingQuery:
    """Read JSON rows (id, text) as they arrive, and append accepted ones to the Parquet table ``corpus``. A batch that is run
    again after a failure replaces its own rows."""
    stream = spark.readStream.schema("id bigint, text string").json(source)

    def settle(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.parquet(corpus).filter(F.col("batch") < batch_id) if path_exists(spark, corpus) else None
        settle_batch(batch, old, threshold, k).write.mode("overwrite").parquet(f"{corpus}/batch={batch_id}")

    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
