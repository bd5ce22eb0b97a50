"""Keyed tables that rewrite touched buckets only, and one file per page with a commit."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.sources import keyed, page_files, readers

SCHEMA = "link string, content string, n long"


def rows(df):
    return sorted(tuple(r) for r in df.select("link", "content", "n").collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "link", buckets=16)
    base = spark.range(500).select(F.concat(F.lit("k"), "id").alias("link"), F.lit("old").alias("content"), F.col("id").alias("n"))
    counts, buckets = t.upsert(base, ["content"])
    assert [tuple(r) for r in counts.collect()] == [("created", 500)] and buckets == list(range(16)) and t.version() == 1
    before = t.folders()
    new = spark.createDataFrame([("k3", "new", 7), ("z", "more", 8), (None, "x", 1), ("", "y", 2)], SCHEMA)
    counts, buckets = t.upsert(new, ["content"])
    got = {r["action"]: r["n"] for r in counts.collect()}
    assert got["updated"] == got["created"] == 1 and len(buckets) <= 2
    after = t.folders()
    assert {b for b in after if after[b] != before.get(b)} == set(buckets)
    want = records.upsert_rows(base, new, "link", ["content"])
    assert rows(t.read()) == rows(want) and rows(t.read(version=1)) == rows(base)
    assert rows(t.lookup(["k3", "z", "none"])) == [("k3", "new", 3), ("z", "more", 8)]
    assert t.vacuum() == len([b for b in buckets if b in before]) and rows(t.read()) == rows(want)
    assert t.upsert(new.limit(0), ["content"])[1] == [] and t.version() == 2


def test_a_run_that_breaks_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "link", buckets=4)
    t.upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], SCHEMA), ["content"])
    monkeypatch.setattr(keyed.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([("a", "2", 9)], SCHEMA), ["content"])
    monkeypatch.undo()
    assert rows(t.read()) == [("a", "1", 1), ("b", "1", 2)] and t.vacuum() == 1
    # two writers from one version: the second fails, nothing of it is seen
    late = keyed.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "link", buckets=4)
    monkeypatch.setattr(late, "version", lambda: 1)
    t.upsert(spark.createDataFrame([("a", "3", 9)], SCHEMA), ["content"])
    with pytest.raises(keyed.Conflict):
        late.upsert(spark.createDataFrame([("b", "4", 9)], SCHEMA), ["content"])
    assert rows(t.read()) == [("a", "3", 1), ("b", "1", 2)]


def test_page_files_are_read_back(spark, tmp_path):
    wiki, path, failed = "https://en.wikipedia.org/wiki/", str(tmp_path / "pages"), str(tmp_path / "failed")
    os.makedirs(path)
    schema = "query string, link string, content string, download_time string"
    text = "x" * 60 + "\n" + "第二行"
    pages = spark.createDataFrame([("q", wiki + "A", text, "2024-01-02 03:04:05"), ("r", wiki + "B", "short", None), ("s", None, text, None), ("t", wiki + "C%2FD", "y" * 50, "t0")], schema)
    page_files.write_page_files(pages, path, failures=failed)
    got = sorted((r["file"], r["query"], r["link"], r["download_time"], r["content"]) for r in readers.header_files(spark, path).collect())
    assert got == [("A.txt", "q", wiki + "A", "2024-01-02 03:04:05", text), ("C_D.txt", "t", wiki + "C%2FD", "t0", "y" * 50)]
    assert sorted((r["query"], r["reason"]) for r in spark.read.json(failed).collect()) == [("r", "too short"), ("s", "no link")]
    # names that exist stay as they are, and nothing is left of the staging
    again = spark.createDataFrame([("other", wiki + "A", "z" * 70, "t1"), ("u", wiki + "E", "e" * 70, "t1")], schema)
    page_files.write_page_files(again, path)
    assert sorted(os.listdir(path)) == ["A.txt", "C_D.txt", "E.txt"]
    assert {r["query"] for r in readers.header_files(spark, path).collect()} == {"q", "t", "u"}


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    os.makedirs(path)
    spark.dataSource.register(page_files.PageFiles)
    df = spark.range(4).repartition(2).select(F.concat("id", F.lit(".txt")).alias("filename"), F.when(F.col("id") < 3, "text").otherwise(F.raise_error(F.lit("bad")).cast("string")).alias("value"))
    with pytest.raises(Exception):  # noqa: B017
        df.write.format("page_files").mode("append").option("path", path).save()
    assert os.listdir(path) == []


def test_a_task_that_starts_after_an_abort_leaves_nothing(tmp_path):
    writer = page_files.PageFiles({"path": str(tmp_path)}).writer(None, False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([{"filename": "late.txt", "value": "late"}]))
    assert os.listdir(tmp_path) == []


def test_a_repeated_attempt_leaves_no_second_file(tmp_path):
    writer = page_files.PageWriter(str(tmp_path), "_stage-x")
    row = lambda name, value: {"filename": name, "value": value}
    writer.write(iter([row("a.txt", "lost")]))
    done = writer.write(iter([row("a.txt", "kept"), row("b.txt", "b")]))
    writer.commit([done, None])
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt"] and (tmp_path / "a.txt").read_text() == "kept"
