"""Tables by key that are updated in place of whole rewrites: only buckets that hold a changed key are written again.

Rows lie in ``buckets`` folders by a hash of their key. An upsert reads and merges the buckets of the new rows' keys, writes these as new versions
beside the old ones, and then commits by creating one small file that names each bucket's current version. That file is created or it
isn't: a run that breaks off leaves the old table, and its folders are no part of it until ``vacuum`` deletes them. Of two writers that start from
one version the second to commit fails. Counts are taken from the committed files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import cut
from ..operators.records import upsert_rows


class Conflict(Exception):
    """Another writer committed first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema: StructType = StructType.fromDDL(schema)
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path_of = path_of
        self._fs = path_of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last committed version, 0 for a table that nothing was written to."""
        log = self._path_of(f"{self.path}/log")
        if not self._fs.exists(log):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(log)), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows: one entry a bucket."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path_of(f"{self.path}/log/{version}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folder for b, folder in json.loads(text).items()}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        data = bytearray(json.dumps(folders).encode())
        path = self._path_of(f"{self.path}/log/{version}")
        # complete under another name first: a log file is never seen half written
        stage = self._path_of(f"{self.path}/stage-{uuid.uuid4().hex}")
        out = self._fs.create(stage, False)
        out.write(data)
        out.close()
        self._fs.mkdirs(path.getParent())
        if self._fs.exists(path) or not self._fs.rename(stage, path):
            self._fs.delete(stage, False)
            raise Conflict(f"version {version} of {self.path} was committed by another writer")

    def _read(self, folders: Sequence[str], extra: str = "") -> DataFrame:
        schema = StructType([*self.schema.fields, *StructType.fromDDL(extra).fields]) if extra else self.schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(sorted(self.folders(version).values()))

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of a few keys, from their buckets alone."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        wanted = {r[0] for r in asked.select(self._bucket(F.col(self.key))).distinct().collect()}
        return self._read(sorted(f for b, f in self.folders().items() if b in wanted)).join(F.broadcast(asked), self.key, "left_semi")

    def upsert(self, new: DataFrame, updated: Sequence[str]) -> tuple[DataFrame, list[int]]:
        """Merges ``new`` (one row a key; see ``upsert_rows``); (action, n) of the touched buckets' rows, and the buckets that were written."""
        before = self.version()
        folders = self.folders(before)
        given = cut(new.where(F.coalesce(F.col(self.key).cast("string"), F.lit("")) != "").withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType)))
        touched = sorted(r[0] for r in given.select(self._bucket(F.col(self.key))).distinct().collect())
        if not touched:
            return self.spark.createDataFrame([], "action string, n long"), []
        old = self._read([folders[b] for b in touched if b in folders])
        merged = upsert_rows(old, given, self.key, updated).withColumn("_bucket", self._bucket(F.col(self.key)))
        stage = f"data/{uuid.uuid4().hex}"
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{stage}")
        written = {b: f"{stage}/_bucket={b}" for b in touched}
        self._commit(before + 1, {**folders, **written})
        counts = self._read(list(written.values()), "action string").groupBy("action").agg(F.count(F.lit(1)).alias("n"))
        return counts, touched

    def vacuum(self) -> int:
        """Deletes folders of versions before the current one, and log files; returns how many folders went. Readers of older versions must be done."""
        current, now = set(self.folders().values()), self.version()
        gone = 0
        data = self._path_of(f"{self.path}/data")
        for run in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = run.getPath().getName()
            for part in self._fs.listStatus(run.getPath()):
                place = f"data/{name}/{part.getPath().getName()}"
                if part.isDirectory() and place not in current:
                    gone += bool(self._fs.delete(part.getPath(), True))
        for f in self._fs.listStatus(self._path_of(f"{self.path}/log")) if now else []:
            if int(f.getPath().getName()) < now:
                self._fs.delete(f.getPath(), False)
        return gone


