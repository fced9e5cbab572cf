"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local runs."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/") or f"file://{tempfile.gettempdir()}/loomgraph"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def materialised(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back."""
    path = fresh_folder(df.sparkSession, "round") + "/rows"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all cores, by columns if any are given: a table of a few megabytes comes in one or two partitions, which is too few where a row takes long."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *columns)


#: Rows of a task where each is held until the task ends.
HELD_ROWS = 1_000_000


def dealt(rows: DataFrame, *columns: str, most: int | None = None) -> DataFrame:
    """Rows dealt by columns to as many tasks as their number asks for, so that what a task holds doesn't grow with it.

    Adaptive execution sizes tasks by compressed bytes, of which a few stand for many keys. Counts the rows, as for
    stored tables, unless `most` says how many they are at most.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, (rows.count() if most is None else most) // HELD_ROWS + 1)
    return rows.repartition(tasks, *columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str], at: str = "at") -> DataFrame:
    """Adds each row's place from 0 within its `keys`, by `order`.

    Rows are sorted over all tasks. A row's place is its place in its task's run of the keys
    and the size of the runs in the tasks before, so that no task has to hold a group.
    """
    put = rows.orderBy(*keys, *order).select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row"))
    put = materialised(put)
    runs = put.groupBy(*keys, "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_task").alias("_run"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_task") == F.col("_run")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return put.join(runs, same).select(*rows.columns, (F.col("_row") + F.col("_shift")).alias(at))
