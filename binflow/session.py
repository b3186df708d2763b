"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its optimizer size estimate is under this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Beyond this size estimate a cut forgets the estimate, too.
ESTIMATE_LIMIT_BYTES = 1 << 200


def local_session(cores: int | str = "*", app: str = "binflow", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """Times are UTC end to end; pin the session so casts never shift them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="binflow-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage.

    Reliable checkpoint: the rows outlive the executors that wrote them. A checkpoint keeps the
    size estimate, and that of a join is the product of its sides': rounds that build on one
    another would multiply it to a number of millions of digits on the driver. An estimate
    beyond all sense is dropped by writing the rows as a table, which has a size of its own.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    if estimated_bytes(df) <= ESTIMATE_LIMIT_BYTES or "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: narrow columns are packed, and
    Spark knows the table's size."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, dropped when the driver ends."""
    _ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def numbered_by(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with a dense number from 0 in `order`, without a single-task window: rows are
    sorted over all tasks, and each task's rows follow the count of those before it. One count
    for each task comes to the driver."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("n")).orderBy("_task").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_task"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_task long, _first long")
    return placed.withColumn("_task", task).join(F.broadcast(first), "_task").withColumn(name, F.col("_first") + row).drop("_at", "_task", "_first")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context (no effect when it
    already came in an archive, as with --py-files)."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_binflow_shipped", False) or not root.is_dir():
        return
    target = tempfile.mkdtemp(prefix="binflow-package-")
    context.addPyFile(shutil.make_archive(f"{target}/binflow", "zip", root.parent, root.name))
    context._binflow_shipped = True


def estimated_bytes(df: DataFrame) -> int:
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # more digits than Python reads
        return 1 << 10_000


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the estimated size is under `limit`, else leave the
    choice (shuffled join, AQE) to Spark."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (a clock, a mean, a bound) to every row."""
    left = df.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
