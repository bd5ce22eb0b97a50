"""A sink of one text file per page, as a Spark data source with a commit protocol.

Tasks write files into folders of their own; when all tasks are done the driver moves the files of those attempts that succeeded to their
places (a rename each), leaves out names that exist, and deletes the rest. A lost or repeated task leaves nothing behind, and a failed job
leaves the target as it was. File systems are those that pyarrow knows by URI.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

from ..functions import links as L
from ..functions import text as X


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class PageWriter(DataSourceWriter):
    def __init__(self, path: str, stage: str, made: bool = False):
        # made: the stage exists already, so a task that finds none comes after an abort and must not make it again
        self.path, self.stage, self.made = path.rstrip("/"), stage, made

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = self._fs()
        folder, names = f"{root}/{self.stage}/{uuid.uuid4().hex}", []
        files.create_dir(folder, recursive=not self.made)
        for row in iterator:
            with files.open_output_stream(f"{folder}/{row['filename']}") as out:
                out.write(row["value"].encode())
            names.append(row["filename"])
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        files, root = self._fs()

        def publish(task: tuple[str, str]) -> None:
            folder, name = task
            if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                files.move(f"{folder}/{name}", f"{root}/{name}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(publish, [(m.folder, n) for m in messages if m for n in m.names]))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        files, root = self._fs()
        # other tasks may still be writing, and make a folder that is being deleted not empty
        for left in reversed(range(20)):
            if files.get_file_info(f"{root}/{self.stage}").type == fs.FileType.NotFound:
                return
            try:
                files.delete_dir(f"{root}/{self.stage}")
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        writer = PageWriter(self.options["path"], f"_stage-{uuid.uuid4().hex}", made=True)
        files, root = writer._fs()
        files.create_dir(f"{root}/{writer.stage}", recursive=True)
        return writer


def write_page_files(pages: DataFrame, path: str, *, failures: str | None = None, least: int = 50) -> None:
    """One file for each of ``pages`` (query, link, content, and download_time if it has one) that ``header_files`` reads back to the same fields.

    A name that exists is left as it is; of several links with one name the first by link is written. Texts of fewer than ``least`` characters, and rows without a link,
    are appended to the table ``failures`` as (query, link, reason) before anything is published.
    """
    spark = pages.sparkSession
    spark.dataSource.register(PageFiles)
    time = F.col("download_time").cast("string") if "download_time" in pages.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    rows = pages.select("query", "link", "content", time.alias("download_time"), L.filename_from_link(F.col("link"), F.col("query")).alias("filename"))
    reason = F.when(F.coalesce("link", F.lit("")) == "", "no link").when(~X.min_length(F.col("content"), least), "too short")
    rows = rows.withColumn("reason", reason)
    if failures is not None:
        rows.where("reason IS NOT NULL").select("query", "link", "reason").write.mode("append").json(failures)
    first = rows.where("reason IS NULL").groupBy("filename").agg(F.min_by(F.struct("query", "link", "download_time", "content"), "link").alias("r")).select("filename", "r.*")
    line = lambda mark, c: F.concat(F.lit(mark + " "), F.coalesce(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("")), F.lit("\n"))
    text = F.concat(line("# 查询词:", F.col("query")), line("# 链接:", F.col("link")), line("# 下载时间:", F.col("download_time")), F.lit("# " + "=" * 50 + "\n\n"), F.col("content"))
    first.select("filename", text.alias("value")).write.format("page_files").mode("append").option("path", path).save()
