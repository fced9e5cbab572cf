"""Session defaults for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "loomgraph") -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it.

    Enough for local runs and shared file systems; elsewhere submit it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder, on any store that Spark reads."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
