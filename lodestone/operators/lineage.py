"""Lineage cuts for iterative operators, and folders for tables that outlive a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder (``spark.checkpoint.dir``); only a local master without that setting gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, so that a lost executor doesn't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(table: DataFrame) -> DataFrame:
    """A table as read, on all cores: one in fewer partitions than there are cores, such as a single file, is dealt out."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def unguessed(table: DataFrame) -> DataFrame:
    """For the larger side of a join: it is shuffled and never sent whole through the driver. Spark takes a checkpointed table's size from the compressed
    files behind it, up to a hundredth of what its rows take in memory."""
    return table.hint("merge")


def asking(table: DataFrame, rows: int = 20_000) -> DataFrame:
    """For the smaller side of a join: broadcast if it is counted to be small, else shuffled. It is read for the count, so cut it before."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")
