"""What the operators of this subpackage share: table access, lineage cuts, batching."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that become words or numbers together where nothing is gained by more; what Python makes of them is many times as large.
PART = 400_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder that was set in the context.

    Where both are unset, a local master (one machine, as in tests) gets a temporary folder; on a cluster that is an error,
    since no other machine could read what is written there.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodestone-"))
        known = sc.getCheckpointDir()
    return configured or known


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor never loses it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: columns are encoded and compressed, so a wide table takes a fraction of a checkpoint's disk.

    The write's own shuffle files go as soon as it ends, since nothing reads them again. The table stays
    until the folder is cleared, as results that are read later depend on it.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more. Only folders below the shared one are touched."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/").removeprefix("file:")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids stay null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def task_count(spark: SparkSession, minimum: int = 1) -> int:
    """Partitions for a shuffle that the session would pick itself."""
    return max(minimum, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(texts: list, budget: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``budget`` characters each, so that one batch never holds all its tokens at once."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > budget:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def process_cache() -> dict:
    """What a Python worker keeps between tasks; it is never pickled with the functions that use it."""
    return sys.modules.setdefault("_lodestone_process", types.ModuleType("_lodestone_process")).__dict__
