"""Readers of record, annotation and text files. No file passes through the driver, and nothing runs before an action but where lines are numbered
(``numbered_lines``, ``bio_tsv``, ``parallel_bio``): those write their lines to the shared folder first."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import annotation
from ..operators.lineage import cut
from ..operators.records import switched_union, train_dev_split

ENTITIES = "array<struct<start:int,end:int,type:string>>"
# Encodings in the order in which they are tried, and the marks of a text file's header.
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "utf-16", "latin1", "cp1252")
HEADER = {"query": "# 查询词:", "link": "# 链接:", "download_time": "# 下载时间:"}
BODY = "# ="


def lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(value, file): the non-blank lines of text files."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.text(path if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """(file, row, bad): each line as a record; ``bad`` holds the line if it is none."""
    fields = T._parse_datatype_string(schema)
    whole = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    return rows.select("file", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"}).alias("row"), "value").select(
        "file", "row", F.when(F.col("row").isNull(), F.col("value")).otherwise(F.col("row._bad")).alias("bad"))


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, *, bad: str = "skip", glob: str | None = None) -> DataFrame:
    """Records of JSON lines. bad: ``skip`` leaves out lines that are no records (``bad_lines`` lists them), ``fail`` ends the job."""
    rows = parsed(lines(spark, path, glob), schema)
    names = [f"row.{f.name}" for f in T._parse_datatype_string(schema).fields]
    if bad == "fail":
        strict = F.when(F.col("bad").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("bad"))).cast(rows.schema["row"].dataType))
        return rows.select(strict.alias("row")).select(*names)
    return rows.where("bad IS NULL").select(*names)


def bad_lines(spark: SparkSession, path: str | Sequence[str], schema: str, glob: str | None = None) -> DataFrame:
    """(file, bad): the lines that ``jsonl`` skips."""
    return parsed(lines(spark, path, glob), schema).where("bad IS NOT NULL").select("file", "bad")


def jsonl_folder(spark: SparkSession, folder: str, schema: str, *, bad: str = "skip") -> DataFrame:
    """The records of all ``*.jsonl`` files of a folder, with their ``file``."""
    rows = parsed(lines(spark, folder, "*.jsonl"), schema)
    return rows.where("bad IS NULL").select("file", "row.*").drop("_bad") if bad == "skip" else jsonl(spark, folder, schema, bad=bad, glob="*.jsonl")


def whole_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, value): a row per file, for formats whose records span lines. Such files are small; their number isn't limited."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    return reader.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def numbered_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, *, blank: str = r"^\s*$") -> DataFrame:
    """(file, line, value, is_blank, blanks): all lines, blank ones too, with their number in the file from 0 and the number of blank lines before.

    Files are read by byte ranges; a line's number is its place in its range plus the lines of the file's ranges before, which are counted first. Lines are
    written once, so that a range is never dealt differently between counting and numbering.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    meta = F.col("_metadata")
    rows = reader.text(path if isinstance(path, str) else list(path)).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), "value", F.col("value").rlike(blank).alias("is_blank"))
    rows = cut(rows)
    ranges = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.count_if("is_blank").alias("b"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    # a row a range
    ranges = ranges.select("file", "start", (before("n") - F.col("first")).alias("shift"), before("b").alias("b"))
    within = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum(F.col("is_blank").cast("long")).over(within), F.lit(0)))
    return rows.join(ranges, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value", "is_blank", (F.col("own") + F.col("b")).alias("blanks"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, json, bad): the records of files that are one JSON value (of an array, its items) or else JSON lines; ``bad``: a line that is none."""
    files = whole_files(spark, path).select("file", "value", F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    rows = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    # the parser stops after the first value, so an object that ends with its line is one of several
    by_line = F.col("v").isNull() | (kind.startswith("OBJECT") & (F.size(rows) > 1) & F.try_parse_json(F.get(rows, F.lit(0))).isNotNull())
    items = F.when(by_line, rows).when(
        kind.startswith("ARRAY"), F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array("value"))
    rows = files.select("file", F.explode(items).alias("json"))
    ok = F.try_parse_json("json").isNotNull()
    return rows.select("file", F.when(ok, F.col("json")).alias("json"), F.when(~ok, F.col("json")).alias("bad"))


def examples(rows: DataFrame, text: Column, spans: Column) -> DataFrame:
    """(text, labels) of texts that are not empty."""
    out = rows.select(text.alias("text"), spans.alias("spans")).where(F.coalesce("text", F.lit("")) != "")
    return out.select("text", annotation.encode_spans(F.col("text"), F.col("spans")).alias("labels"))


def ner_json(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(text, labels) of files that hold one JSON array of {text, entities}."""
    items = whole_files(spark, path, glob).select(F.explode(F.from_json("value", f"array<struct<text:string,entities:{ENTITIES}>>")).alias("r"))
    return examples(items, F.col("r.text"), F.col("r.entities"))


def polymorphic_json(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(text, labels) of JSON files of four shapes: {file: text, ...} without labels, {originalText, entities}, {text, entities}, or an array
    of the latter two. Entities name their ends start_pos and end_pos or start and end, their type label_type or type. Files are decoded
    by the first encoding that fits."""
    files = spark.read.format("binaryFile")
    files = files if glob is None else files.option("pathGlobFilter", glob)
    value = files.load(path).select(F.try_parse_json(decode_bytes(F.col("content"))["text"]).alias("v"))
    kind = F.schema_of_variant("v")
    get = lambda v, p, t: F.try_variant_get(v, p, t)
    has = lambda k: kind.rlike(rf"(^OBJECT<|[ ,<]){k}: ")
    plain = kind.startswith("OBJECT") & ~has("text") & ~has("originalText") & ~has("entities")
    texts = value.where(plain).select(F.explode(F.map_values(get(F.col("v"), "$", "map<string,string>"))).alias("text"))
    unlabelled = examples(texts, F.col("text"), F.array().cast(ENTITIES))
    items = value.where(kind.startswith("ARRAY")).select(F.explode(get(F.col("v"), "$", "array<variant>")).alias("v"))
    items = items.unionByName(value.where(kind.startswith("OBJECT") & ~plain))
    v = F.col("v")
    spans = F.transform(F.coalesce(get(v, "$.entities", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.struct(
        F.coalesce(get(e, "$.start_pos", "int"), get(e, "$.start", "int")).alias("start"), F.coalesce(get(e, "$.end_pos", "int"), get(e, "$.end", "int")).alias("end"),
        F.coalesce(get(e, "$.label_type", "string"), get(e, "$.type", "string")).alias("type")))
    return unlabelled.unionByName(examples(items, F.coalesce(get(v, "$.originalText", "string"), get(v, "$.text", "string")), spans))


def bio_tsv(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(text, labels) of files with a character, a tab and its tag a line, and a blank line after each sentence. A character
    without a tag is O; a space may be a character.

    Files are read by byte ranges; a line's sentence is the number of blank lines before it, counted in its range and in the file's ranges before.
    """
    lines = numbered_lines(spark, path, glob, blank=r"^[ \t]*$")
    rows = lines.where("NOT is_blank").groupBy("file", "blanks").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("r"))
    rows = rows.select(F.col("r.value").alias("rows"))
    chars = F.transform("rows", lambda r: F.split(r, "\t")[0])
    tags = F.transform("rows", lambda r: F.coalesce(F.nullif(F.trim(F.get(F.split(r, "\t"), F.lit(1))), F.lit("")), F.lit("O")))
    out = rows.where(F.size("rows") > 0).select(F.array_join(chars, "").alias("text"), tags.alias("labels"))
    return out.where(F.char_length("text") == F.size("labels"))


def span_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, labels) of lines {content, result_list: [{text, start, end, prompt}], prompt}: a span's type is its own prompt, else the
    line's, else ``ENTITY``."""
    rows = jsonl(spark, path, "content string, result_list array<struct<text:string,start:int,end:int,prompt:string>>, prompt string")
    spans = F.transform("result_list", lambda s: F.struct(s["start"], s["end"], F.coalesce(s["prompt"], F.col("prompt")).alias("type")))
    return examples(rows, F.col("content"), spans)


def parallel_bio(spark: SparkSession, sentences: str | Sequence[str], tags: str | Sequence[str]) -> DataFrame:
    """(text, labels) of line-aligned files of space-separated characters and tags; lines of different or no length are left out.

    Of several files (lists, globs) the first by name of one side belongs to the first of the other, and so on; both sides must have as many.
    """

    def numbered(path: str | Sequence[str], name: str) -> DataFrame:
        rows = numbered_lines(spark, path)
        # one row a file
        order = rows.select("file").distinct().withColumn("pair", F.row_number().over(Window.orderBy("file")))
        words = F.filter(F.split("value", r"(?U)\s+"), lambda x: x != "")
        return rows.join(F.broadcast(order), "file").select("pair", "line", words.alias(name))

    counts = [len(whole_files(spark, p).inputFiles()) for p in (sentences, tags)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} files of sentences, {counts[1]} of tags")
    both = numbered(sentences, "chars").join(numbered(tags, "labels"), ["pair", "line"])
    return both.where((F.size("chars") == F.size("labels")) & (F.size("chars") > 0)).select(F.array_join("chars", "").alias("text"), "labels")


def training_sets(sources: Mapping[str, DataFrame], dev: Mapping[str, DataFrame], switches: Mapping[str, bool], order: str = "text") -> DataFrame | None:
    """All enabled sources as (text, labels, source, split). Development sources count only if they hold any label; without any, a part
    of the training rows is split off."""
    train = switched_union(dict(sources), dict(switches))
    if train is None:
        return None
    held = switched_union({k: annotation.usable_validation(v) for k, v in dev.items()}, dict(switches), "dev")
    return train_dev_split(train.drop("split"), order, None if held is None else held.drop("split"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Bytes as text by the first of ``ENCODINGS`` that fits, and its name."""

    def one(data: bytes) -> tuple[str | None, str | None]:
        for name in ENCODINGS if data is not None else ():
            try:
                return bytes(data).decode(name), name
            except UnicodeError:
                continue
        return None, None

    for batch in batches:
        yield pd.DataFrame([one(x) for x in batch], columns=["text", "encoding"])


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text, encoding) of files of any of the known encodings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), decode_bytes(F.col("content")).alias("d")).select("file", "d.text", "d.encoding")


def gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, correct_link) as they stand in a CSV file without a header; a spreadsheet is read if the adapter for it is installed."""
    if path.endswith((".xlsx", ".xls")):
        both = pd.read_excel(path, header=None, dtype=str)
        return spark.createDataFrame([(q if isinstance(q, str) else None, a if isinstance(a, str) else None) for q, a in zip(both[0], both[1], strict=True)], "query string, correct_link string")
    return spark.read.schema("query string, correct_link string").csv(path, escape='"', multiLine=True)


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs trimmed, those without a query or a link left out."""
    trimmed = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "").alias(c) for c in ("query", "correct_link")]
    return pairs.select(*trimmed).where("query <> '' AND correct_link <> ''")


def header_files(spark: SparkSession, path: str, *, form: str = "strict", skip: Sequence[str] = ("failed_links.txt",)) -> DataFrame:
    """(file, query, link, download_time, content) of text files with a commented header.

    strict: header fields anywhere, the body is the non-blank lines after the ``# =`` line, none without it. lines: header fields before the
    ``# =`` line only, the body is everything after it, blank lines included, and the whole file without it.
    """
    files = whole_files(spark, path, "*.txt").withColumn("file", F.element_at(F.split("file", "/"), -1)).where(~F.col("file").isin(*skip))
    rows = F.split("value", "\n")
    mark = F.array_position(F.transform(rows, lambda x: x.startswith(BODY)), True)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    if form == "strict":
        fields = [F.nullif(strip(F.regexp_extract("value", rf"{m}\s*(.+)", 1)), F.lit("")).alias(n) for n, m in HEADER.items()]
        body = F.filter(F.slice(rows, mark + 1, F.size(rows)), lambda x: (strip(x) != "") & ~x.startswith(BODY))
        body = F.when(mark > 0, F.array_join(body, "\n")).otherwise("")
    else:
        head = F.when(mark > 0, F.slice(rows, F.lit(1), F.greatest(mark, F.lit(1)) - 1)).otherwise(rows)
        last = lambda m: F.try_element_at(F.filter(head, lambda x: x.startswith(m)), F.lit(-1))
        fields = [strip(F.replace(last(m), F.lit(m), F.lit(""))).alias(n) for n, m in HEADER.items()]
        body = F.array_join(F.slice(rows, mark + 1, F.size(rows)), "\n")
    return files.select("file", *fields, strip(body).cast("string").alias("content"))


def index(spark: SparkSession, name: str, *fallbacks: str) -> DataFrame:
    """The first of the named tables that exists."""
    found = next((n for n in (name, *fallbacks) if spark.catalog.tableExists(n)), None)
    if found is None:
        raise ValueError(f"no table {', '.join((name, *fallbacks))}")
    return spark.table(found)


def sample(df: DataFrame, fields: Sequence[str], n: int) -> DataFrame:
    """Any ``n`` rows, the given fields only."""
    return df.select(*fields).limit(n)


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON report as one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a label-mapping file."""
    one = report(spark, path, "id_to_label map<string,string>")
    return one.select(F.explode("id_to_label").alias("id", "label")).select(F.col("id").cast("int").alias("id"), "label")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a log without progress bars."""
    return spark.read.text(path).where(~X.is_progress_line(F.col("value")))
