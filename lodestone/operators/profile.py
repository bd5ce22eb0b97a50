"""Profiles of record tables: completeness, entity statistics, quality checks, recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(df: DataFrame, name: str) -> Column:
    """True unless the value is null, a blank string, or an empty array or map."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") != "", F.lit(False))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, filled, empty, percent) in one pass; percent of an empty table is 0."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(filled(df, f)).alias(f) for f in fields])
    long = one.unpivot("_n", list(fields), "field", "filled")
    return long.select("field", "filled", (F.col("_n") - F.col("filled")).alias("empty"), F.round(F.coalesce(F.try_divide(F.col("filled") * 100.0, "_n"), F.lit(0.0)), 2).alias("percent"))


def any_filled(df: DataFrame, fields: Sequence[str], least: int = 1) -> Column:
    """True where at least ``least`` of the fields are filled."""
    return sum((filled(df, f).cast("int") for f in fields), F.lit(0)) >= least


def status(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: documents, how many have any of the fields, and a map of the filled counts."""
    counts = F.create_map(*[x for f in fields for x in (F.lit(f), F.count_if(filled(df, f)))])
    return df.agg(F.count(F.lit(1)).alias("documents"), F.count_if(any_filled(df, fields)).alias("any"), counts.alias("fields"))


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, added) row counts."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(before, "before").join(F.broadcast(n(after, "after"))).select("before", "after", (F.col("after") - F.col("before")).alias("added"))


def outcome_rates(rows: DataFrame, outcome: str, good: Sequence[str]) -> DataFrame:
    """(outcome, n, success_percent): a histogram, each row with the share of good outcomes in all."""
    each = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    whole = each.agg(F.round(F.try_divide(F.sum(F.when(F.col(outcome).isin(*good), F.col("n")).otherwise(0)) * 100.0, F.sum("n")), 6).alias("success_percent"))
    return each.join(F.broadcast(whole))


def word_coverage(rows: DataFrame, zh: str, en: str) -> DataFrame:
    """One row on entity words: records, those with zh, en or any words, and mean words per record."""
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(n(zh) > 0).alias("with_zh"), F.count_if(n(en) > 0).alias("with_en"), F.count_if(n(zh) + n(en) > 0).alias("with_any"),
        F.round(F.avg(n(zh)), 6).alias("mean_zh"), F.round(F.avg(n(en)), 6).alias("mean_en"))


def category_totals(rows: DataFrame, counts: Sequence[str]) -> DataFrame:
    """One row: categories and the sums of their counts."""
    return rows.agg(F.count(F.lit(1)).alias("categories"), *[F.sum(c).alias(c) for c in counts])


#: (category, level, condition over the facts' columns): the first fitting rule of each category speaks.
RULES = (
    ("data size", "warning", "train_samples < 1000"), ("data size", "info", "train_samples < 5000"), ("data size", "success", "train_samples >= 5000"),
    ("validation", "warning", "dev_samples = 0"), ("validation", "info", "dev_samples < train_samples * 0.1"),
    ("model", "success", "f1 >= 0.98"), ("model", "info", "f1 >= 0.95"), ("model", "warning", "f1 >= 0.90"), ("model", "error", "f1 > 0"),
    ("epochs", "warning", "epochs < 3"), ("epochs", "info", "epochs > 10"),
    ("extraction", "error", "tests > 0 AND extracted = 0"), ("extraction", "warning", "extracted < tests * 0.5"),
    ("types", "info", "entity_types > 30"))
SEVERITY = ("error", "warning", "info", "success")


def recommendations(facts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(place, level, category) of what the rules say about one row of facts, worst first, else in the order of the rules."""
    missing = [c for c in ("train_samples", "dev_samples", "entity_types", "f1", "epochs", "tests", "extracted") if c not in facts.columns]
    facts = facts.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])
    by: dict[str, Column] = {}
    for i, (category, level, when) in enumerate(rules):
        said = F.struct(F.lit(SEVERITY.index(level)).alias("severity"), F.lit(i).alias("rule"), F.lit(level).alias("level"), F.lit(category).alias("category"))
        by[category] = by[category].when(F.expr(when), said) if category in by else F.when(F.expr(when), said)
    found = F.array_sort(F.filter(F.array(*by.values()), lambda r: r.isNotNull()))
    return facts.select(F.posexplode(found).alias("place", "r")).select("place", "r.level", "r.category")


def quality_checks(df: DataFrame, checks: Mapping[str, Column], *, key: str | None = None, least_rows: int = 1) -> DataFrame:
    """(check, failed, passed): how many rows break each condition, whether keys repeat, and whether there are enough rows."""
    n = F.count(F.lit(1))
    counts = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in checks.items()}
    counts["rows"] = F.when(n >= least_rows, 0).otherwise(1).cast("long")
    if key is not None:
        counts["unique"] = F.count(key) - F.count_distinct(key)
    one = df.agg(*[c.alias(name) for name, c in counts.items()])
    return one.unpivot([], list(counts), "check", "failed").withColumn("passed", F.col("failed") == 0)


def log_summary(spark: SparkSession, lines: DataFrame, line: str = "value") -> DataFrame:
    """One row on a training log whose lines hold dict literals: best F1 and accuracy, last epoch, run time; null where no line says."""
    text = F.replace(F.regexp_extract(line, r"(\{.*\})", 1), F.lit("'"), F.lit('"'))
    said = F.from_json(text, "eval_f1 double, eval_accuracy double, epoch double, train_runtime double")
    rows = lines.where(F.col(line).contains("{") & (F.col(line).contains("eval_f1") | F.col(line).contains("train_runtime"))).select(said.alias("s"))
    return rows.agg(F.max("s.eval_f1").alias("f1"), F.max("s.eval_accuracy").alias("accuracy"), F.max(F.floor("s.epoch")).alias("epochs"), F.max("s.train_runtime").alias("seconds"))
