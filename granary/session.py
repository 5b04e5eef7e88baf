"""Session helpers: creation for local runs, the shared folder, spreading and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "granary", cores: int | str = "*") -> SparkSession:
    """A session for local runs and tests; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a machine's own only in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint reliably in the shared folder, so that later stages neither recompute ``df`` nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: Column | str, name: str = "slot") -> DataFrame:
    """Adds ``name``: places from 0 in a total order. Rows are sorted by ranges on all tasks; only the number of rows of each
    range comes to the driver, and goes back as offsets."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    offsets, total = [], 0
    for r in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((r["_part"], total))
        total += r["count"]
    if not offsets:
        return placed.withColumn(name, F.col("_at")).drop("_part", "_at")
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _first bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


_staged: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_staged() -> None:
    """Tables that were staged by this program, as far as the session still lives."""
    for spark, path in _staged:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone, and with it the way to the folder
            return


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again: like :func:`cut`, for wide or text rows."""
    path = f"{shared_dir(df.sparkSession)}/granary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition only where a scan has fewer splits than the cluster has cores (a few small files)."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= least:
        return df
    return df.repartition(least)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it: local disks, HDFS and object stores alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return bool(fs.exists(p))


def read_file(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and renamed, so that it is there whole or not at all."""
    fs, p = filesystem(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"{path} could not be put in place")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package for functions that run in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="granary-ship-")) / "granary.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("granary") / p.relative_to(root))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
