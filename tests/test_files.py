"""Readers, writers and streams on files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.sources import readers, writers
from lodestone.streaming import ingest


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def pairs(df):
    return sorted((r["text"], r["labels"]) for r in df.collect())


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "d" / "a.jsonl", '{"a": 1, "b": "x"}\n\nbroken\n{"a": 2}\n')
    write(tmp_path / "d" / "b.txt", "ignored")
    write(tmp_path / "d" / "c.jsonl", '{"a": 3}\n')
    schema = "a long, b string"
    assert sorted(tuple(r) for r in readers.jsonl(spark, path, schema).collect()) == [(1, "x"), (2, None)]
    assert [r["bad"] for r in readers.bad_lines(spark, path, schema).collect()] == ["broken"]
    with pytest.raises(Exception, match="bad line"):
        readers.jsonl(spark, path, schema, bad="fail").collect()
    assert sorted(r["a"] for r in readers.jsonl_folder(spark, str(tmp_path / "d"), schema).collect()) == [1, 2, 3]


def test_json_records(spark, tmp_path):
    a = write(tmp_path / "a.json", '[{"x": 1},\n {"x": 2}]')
    b = write(tmp_path / "b.json", '{"x": 3}\n{"x": \n{"x": 4}')
    c = write(tmp_path / "c.json", '{"x":\n 5}')
    got = [(r["json"], r["bad"]) for p in (a, b, c) for r in readers.json_records(spark, p).collect()]
    assert sorted(json.loads(j)["x"] for j, bad in got if bad is None) == [1, 2, 3, 4, 5] and [bad for _, bad in got if bad] == ['{"x": ']


def test_annotation_readers(spark, tmp_path):
    ner = write(tmp_path / "x_ner_train.json", json.dumps([{"text": "ABCDE", "entities": [{"start": 0, "end": 2, "text": "AB", "type": "T"}]}, {"text": "", "entities": []}]))
    assert pairs(readers.ner_json(spark, ner)) == [("ABCDE", ["B-T", "I-T", "O", "O", "O"])]
    shapes = {
        "1.json": {"f1": "甲乙", "f2": ""}, "2.json": {"originalText": "甲乙丙", "entities": [{"start_pos": 1, "end_pos": 3, "label_type": "W"}]},
        "3.json": {"text": "abc", "entities": [{"start": 0, "end": 1, "type": ""}, {"start": 2, "end": 9, "type": "X"}]},
        "4.json": [{"originalText": "de", "entities": [{"start_pos": 0, "end_pos": 2, "label_type": "L"}]}, {"text": "f"}]}
    for name, data in shapes.items():
        write(tmp_path / "ccks" / name, json.dumps(data, ensure_ascii=False), "gbk" if name == "2.json" else "utf-8")
    assert pairs(readers.polymorphic_json(spark, str(tmp_path / "ccks"), "*.json")) == sorted([
        ("甲乙", ["O", "O"]), ("甲乙丙", ["O", "B-W", "I-W"]), ("abc", ["B-ENTITY", "O", "O"]), ("de", ["B-L", "I-L"]), ("f", ["O"])])
    bio = write(tmp_path / "bio.txt", "甲\tB-T\n乙\tI-T\n \tO\nx\n\n丙\tO\n\n\n")
    assert pairs(readers.bio_tsv(spark, bio)) == sorted([("甲乙 x", ["B-T", "I-T", "O", "O"]), ("丙", ["O"])])
    spans = write(tmp_path / "train.txt", '{"content": "abcd", "result_list": [{"text": "ab", "start": 0, "end": 2}, {"text": "d", "start": 3, "end": 4, "prompt": "P"}], "prompt": "G"}\n{"content": "e", "result_list": [{"start": 0, "end": 1}]}\nbad\n')
    assert pairs(readers.span_jsonl(spark, spans)) == [("abcd", ["B-G", "I-G", "O", "B-P"]), ("e", ["B-ENTITY"])]
    s, t = write(tmp_path / "sentences.txt", "甲 乙\na b c\n\nd\n"), write(tmp_path / "tags.txt", "B-T I-T\nO O\n\nO\n")
    assert pairs(readers.parallel_bio(spark, s, t)) == [("d", ["O"]), ("甲乙", ["B-T", "I-T"])]
    more = [write(tmp_path / "s b.txt", "x"), write(tmp_path / "s c.txt", "y z")], [write(tmp_path / "t1.txt", "B-Q"), write(tmp_path / "t2.txt", "B-R I-R")]
    assert pairs(readers.parallel_bio(spark, *more)) == [("x", ["B-Q"]), ("yz", ["B-R", "I-R"])]
    with pytest.raises(ValueError):
        readers.parallel_bio(spark, more[0], t)


def test_training_sets(spark):
    rows = lambda n, tag, start=0: spark.createDataFrame([(f"t{start + i:03}", [tag]) for i in range(n)], "text string, labels array<string>")
    sources, on = {"traindata": rows(12, "B-A"), "train_txt": rows(3, "O", 50)}, {"traindata": True, "train_txt": False, "msra_test": True}
    held = lambda tag: {r["split"]: r["count"] for r in readers.training_sets(sources, {"msra_test": rows(4, tag, 90)}, on).groupBy("split").count().collect()}
    assert held("B-A") == {"train": 12, "dev": 4} and held("O") == {"train": 9, "dev": 3}
    assert readers.training_sets(sources, {}, {}) is None


def test_text_and_header_files(spark, tmp_path):
    write(tmp_path / "t" / "a.txt", "# 查询词: 甲\n# 链接:  https://a\n# 下载时间: now\n# ====\n\nline 1\n\nline 2\n")
    write(tmp_path / "t" / "b.txt", "no header\n\nbody")
    write(tmp_path / "t" / "failed_links.txt", "x")
    strict = {r["file"]: tuple(r)[1:] for r in readers.header_files(spark, str(tmp_path / "t")).collect()}
    assert strict == {"a.txt": ("甲", "https://a", "now", "line 1\nline 2"), "b.txt": (None, None, None, "")}
    free = {r["file"]: tuple(r)[1:] for r in readers.header_files(spark, str(tmp_path / "t"), form="lines").collect()}
    assert free == {"a.txt": ("甲", "https://a", "now", "line 1\n\nline 2"), "b.txt": (None, None, None, "no header\n\nbody")}
    write(tmp_path / "e" / "u.txt", "é中")
    write(tmp_path / "e" / "g.txt", "中文字", "gb18030")
    (tmp_path / "e" / "l.txt").write_bytes(b"\x81")
    got = {r["file"][-5:]: (r["text"], r["encoding"]) for r in readers.text_files(spark, str(tmp_path / "e")).collect()}
    assert got == {"u.txt": ("é中", "utf-8"), "g.txt": ("中文字", "gbk"), "l.txt": ("\x81", "latin1")}


def test_small_files(spark, tmp_path):
    gold = readers.gold_pairs(spark, write(tmp_path / "find.csv", ' 甲 ,https://a \n,https://b\n"x, y",z\n'))
    assert gold.count() == 3 and sorted(tuple(r) for r in readers.clean_pairs(gold).collect()) == [("x, y", "z"), ("甲", "https://a")]
    labels = write(tmp_path / "map.json", '{"id_to_label": {"0": "O",\n "1": "B-X"}}')
    assert sorted(tuple(r) for r in readers.label_map(spark, labels).collect()) == [(0, "O"), (1, "B-X")]
    log = write(tmp_path / "x.log", " 3%|# | 1/30 [00:01]\nloss 3%|# | 1/30 epoch\nplain\n")
    assert readers.log_lines(spark, log).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string")
    path = str(tmp_path / "out")
    writers.write_jsonl(df, path)
    writers.write_jsonl(df, path, mode="append")
    assert readers.jsonl(spark, path, "a long, b string").count() == 4
    assert any('"b":"é"' in p.read_text() for p in (tmp_path / "out").glob("*.json")) and any('"b":null' in p.read_text() for p in (tmp_path / "out").glob("*.json"))
    writers.rewrite(spark, path, "a long, b string", lambda x: x.withColumn("a", F.col("a") * 10))
    assert sorted(r["a"] for r in readers.jsonl(spark, path, "a long, b string").collect()) == [10, 10, 20, 20] and len(list(tmp_path.iterdir())) == 1
    write(tmp_path / "m" / "a.jsonl", "x\n\ny")
    write(tmp_path / "m" / "b.jsonl", "z\n")
    writers.concat_files(spark, str(tmp_path / "m"), str(tmp_path / "one"))
    assert sorted(p.read_text() for p in (tmp_path / "one").glob("part*"))[0].split() == ["x", "y", "z"]
    assert writers.collapse(df, "b", "redirect_link").first()["json"] == '{"redirect_link":["é"]}'
    writers.write_report(df.limit(1), str(tmp_path / "report"))
    assert set(readers.report(spark, str(tmp_path / "report"), "a long, timestamp string").first().asDict()) == {"a", "timestamp"}
    writers.write_sample(spark.range(9).toDF("a"), str(tmp_path / "sample"))
    assert spark.read.json(str(tmp_path / "sample")).count() == 5


def test_indexes(spark):
    name, rejects = "test_index", "test_rejects"
    try:
        writers.create_index(spark, name, "link string, content string, label string")
        rows = spark.createDataFrame([("a", "x", "A"), (None, "y", "B"), ("b", None, "C")], "link string, content string, label string")
        assert {tuple(r) for r in writers.index_rows(rows, name, F.col("link").isNotNull(), rejects=rejects).collect()} == {("indexed", 2), ("rejected", 1)}
        assert spark.table(rejects).count() == 1
        writers.index_one(spark, name, {"link": "c", "label": "D"})
        new = spark.createDataFrame([("a", "new", "Z"), ("d", "more", "E"), ("", "no key", "F")], "link string, content string, label string")
        assert {tuple(r) for r in writers.upsert_index(spark, name, new, "link", ["content"]).collect()} == {("updated", 1), ("created", 1), ("kept", 2)}
        assert {tuple(r) for r in writers.upsert_index(spark, name, new, "link", ["content"]).collect()} == {("updated", 2), ("kept", 2)}
        writers.add_fields(spark, name, {"content_vector": "array<float>", "label": "string"})
        assert spark.table(name).columns == ["link", "content", "label", "content_vector"]
        assert {(r["link"], r["content"], r["label"]) for r in readers.index(spark, "missing", name).collect()} == {("a", "new", "A"), ("b", None, "C"), ("c", None, "D"), ("d", "more", "E")}
        assert readers.sample(spark.table(name), ["link"], 2).count() == 2
        with pytest.raises(ValueError):
            readers.index(spark, "missing")
    finally:
        for t in (name, rejects):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_pages_are_written_once(spark, tmp_path):
    wiki, path = "https://en.wikipedia.org/wiki/", str(tmp_path / "pages")
    pages = spark.createDataFrame([("q", wiki + "A", "x" * 60), ("r", wiki + "B", "short")], "query string, link string, content string")
    assert [tuple(r) for r in writers.write_pages(pages, path).collect()] == [("r", wiki + "B", "too short")]
    writers.write_pages(pages.unionByName(spark.createDataFrame([("s", wiki + "C", "y" * 60)], pages.schema)), path)
    got = spark.read.json(path)
    assert sorted(r["filename"] for r in got.collect()) == ["A.txt", "C.txt"] and got.where("filename = 'A.txt'").first()["value"].endswith("\n" + "x" * 60)


def test_streams(spark, tmp_path):
    folder, name = tmp_path / "in", "test_stream"
    write(folder / "a.jsonl", '{"link": "a", "content": "1", "n": 1}\n{"link": "a", "content": "2", "n": 2}\nbroken\n')
    try:
        writers.create_index(spark, name, "link string, content string, n long")
        run = lambda: ingest.upsert_stream(ingest.record_stream(spark, str(folder), "link string, content string, n long"), name, "link", "n", ["content", "n"], str(tmp_path / "ck")).awaitTermination(120)
        run()
        spark.catalog.refreshTable(name)
        assert [tuple(r) for r in spark.table(name).collect()] == [("a", "2", 2)]
        write(folder / "b.jsonl", '{"link": "b", "content": "3", "n": 3}\n')
        run()
        spark.catalog.refreshTable(name)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == [("a", "2", 2), ("b", "3", 3)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_event_stream_matches_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.event_counts(stream, "ts", "event_type", "1 hour", "10 minutes").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r)[:3] for r in ingest.event_counts(events, "ts", "event_type", "1 hour", "10 minutes").collect()}
    assert {tuple(r)[:3] for r in spark.table("counted").collect()} == want
    once = ingest.first_seen(stream, "user_id", "ts", "400 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == events.select("user_id").distinct().count()


def test_inline_images(spark):
    pages = spark.createDataFrame([(1, '<img src="//h/a.jpg"><img src="/b.jpg"><img src="//h/c.jpg">'), (2, "none"), (None, '<img src="//h/a.jpg">')], "id long, html string")
    images = spark.createDataFrame([("https://h/a.jpg", "QQ=="), ("https://en.wikipedia.org/b.jpg", "Qg=="), ("https://h/c.jpg", None)], "url string, data string")
    got = {r["id"]: r["html"] for r in records.inline_images(pages, "id", "html", images, "url", "data").collect()}
    assert got[1] == '<img src="data:image/jpeg;base64,QQ=="><img src="data:image/jpeg;base64,Qg=="><img src="//h/c.jpg">' and got[2] == "none"


def test_annotations_are_read_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    sentences = [[(rng.choice("甲乙ab "), rng.choice(["O", "B-T", "I-T"])) for _ in range(rng.randrange(1, 12))] for _ in range(400)]
    want = sorted(("".join(c for c, _ in x), [t for _, t in x]) for x in sentences)
    block = lambda x, end="\n": end.join(f"{c}\t{t}" for c, t in x)
    plain = write(tmp_path / "plain.txt", "\n\n".join(block(x) for x in sentences) + "\n")
    odd = write(tmp_path / "odd.txt", "\n\n\n".join(block(x) for x in sentences[:200]) + "\n \t\n" + "\n\n\n\n".join(block(x) for x in sentences[200:]))
    windows = tmp_path / "windows.txt"
    windows.write_bytes("\r\n\r\n".join(block(x, "\r\n") for x in sentences).encode())
    lines = [rng.choice(["", "a b", "甲 乙 丙", "x"]) for _ in range(3000)]
    tags = [" ".join(f"B-{i}" for _ in x.split()) for i, x in enumerate(lines)]
    s1, t1 = write(tmp_path / "s" / "1.txt", "\n".join(lines)), write(tmp_path / "t" / "1.txt", "\n".join(tags) + "\n")
    s2, t2 = write(tmp_path / "s" / "2.txt", "\r\n".join(lines[::-1])), write(tmp_path / "t" / "2.txt", "\n".join(tags[::-1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(plain).rdd.getNumPartitions() > 5
        for path in (plain, odd, str(windows)):
            assert pairs(readers.bio_tsv(spark, path)) == want
        got = {r["line"]: r["value"] for r in readers.numbered_lines(spark, s1).collect()}
        assert [got[i] for i in range(len(got))] == lines[:len(got)] and not any(lines[len(got):])
        assert pairs(readers.parallel_bio(spark, [s2, s1], [t1, t2])) == sorted(("".join(x.split()), t.split()) for x, t in zip(lines, tags, strict=True) if x for _ in (1, 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
