"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its DuckDB check where SQL can express it."""

    def add(run):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = ready
        if sql:
            ORACLES[name] = sql
        return ready

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, dropped when the driver ends."""
    session._ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: cuts the lineage, is
    computed once however often it is read, and outlives the executors that wrote it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Drop the shuffle files of steps whose results are stored. Spark does so when nothing on
    the driver refers to them any longer, which it only finds out when it collects garbage; a
    job of many shuffles would keep all of them until its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker keeps between tasks, by the operator that needs it: how to drop it.
KEPT: dict[str, Callable[[], object]] = {}


def working(operator: str) -> None:
    """Called in a worker when a task of an operator begins: what others kept goes, so that a
    worker that serves one operator after another holds the memory of one."""
    others = [drop for name, drop in KEPT.items() if name != operator]
    if others:
        for drop in others:
            drop()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # gives free pages back where the C library can


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of the id's decimal text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


LEAST = -(2**63)


class Ranges:
    """Ascending ranges of a whole-number key, with about equal rows in each.

    64 quantiles cut the key, and each part is cut again into `fine` even steps, so the number
    of ranges can follow the number of tasks while the driver holds 64 values. A null key
    counts as the least.
    """

    def __init__(self, df: DataFrame, key: str, tasks: int | None = None):
        tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = min(64, max(1, tasks))
        self.fine = -(-max(1, tasks) // parts)
        found = df.agg(
            F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("b"),
            F.min(key).alias("lo"), F.max(key).alias("hi"),
        ).first()
        self.lo, self.hi = (0, 0) if found.lo is None else (int(found.lo), int(found.hi))
        self.cuts = sorted({int(x) for x in found.b or [] if int(x) > self.lo}) if parts > 1 else []
        self.count = (len(self.cuts) + 1) * self.fine

    def of(self, key: Column) -> Column:
        starts, ends = [self.lo, *self.cuts], [*self.cuts, self.hi + 1]

        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                step = (key.cast("double") - float(starts[lo])) * (self.fine / max(1, ends[lo] - starts[lo]))
                return F.lit(lo * self.fine) + F.least(F.lit(self.fine - 1), F.greatest(F.lit(0), step.cast("int")))
            mid = (lo + hi) // 2
            return F.when(key >= F.lit(starts[mid + 1]), pick(mid + 1, hi)).otherwise(pick(lo, mid))

        return F.coalesce(pick(0, len(starts) - 1), F.lit(0))


def with_next(df: DataFrame, key: str, columns: list[str], tasks: int | None = None) -> DataFrame:
    """Add next_<column> of the row that follows in ascending `key`; after the last comes the first.

    Rows are dealt to ranges of the key, so each row moves once. The first row of each range
    is also dealt, as a guest, to the range before it. Rows of one key follow one another in
    the order of `columns`; a null key comes first. A single row is followed by itself.
    """
    ranges = Ranges(df, key, tasks)
    kept = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(LEAST))).withColumn("_range", ranges.of(F.col(key)))
    # One number for each range: as many as there are tasks.
    heads = sorted((r["_range"], r["k"]) for r in kept.groupBy("_range").agg(F.min("_k").alias("k")).collect())
    if not heads:
        return df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"next_{c}") for c in columns])
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    guests = kept.where(F.col("_k").isin(list(before))).groupBy("_k").agg(F.min(F.struct(*columns)).alias("_row"))
    guests = guests.select("_k", "_row.*", to[F.col("_k")].alias("_range"), F.lit(True).alias("_guest"))
    everyone = kept.withColumn("_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    follow = Window.partitionBy("_range").orderBy("_guest", "_k", *columns)
    ahead = everyone.withColumn("_next", F.lead(F.struct(*columns)).over(follow)).where(~F.col("_guest"))
    return ahead.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


class Known(dict):
    """A memory of make(key) in two generations of `size` entries: a full one becomes the older,
    and what is found there moves up, so frequent keys stay and the size is bounded. Where
    entries are long, keys and values of MEAN an entry fill a generation."""

    MEAN = 64

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older, self.held = make, size, longest, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size or self.held >= self.MEAN * self.size:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += len(key) + len(value)
        return value
