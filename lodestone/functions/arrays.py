"""Column functions on arrays and maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_strings() -> Column:
    return F.array().cast("array<string>")


def list_of(value: Column) -> Column:
    """A scalar as an array of one; null and empty strings as an empty array."""
    return F.when(F.coalesce(value, F.lit("")) == "", no_strings()).otherwise(F.array(value))


def list_from_json(value: Column) -> Column:
    """JSON that is an array of strings or one string, as an array; anything else is empty."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    some = F.try_variant_get(v, "$", "string")
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(kind == "STRING", list_of(some)).otherwise(no_strings())


def flat_vector(nested: Column) -> Column:
    """The vector of an array that holds one vector."""
    return F.flatten(nested)


def alias_map(aliases: Mapping[str, Column]) -> Column:
    """Aliases by language, languages without any left out; null if none is left."""
    whole = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v, no_strings()).alias("v")) for k, v in aliases.items()]))
    some = F.map_filter(whole, lambda _, v: F.size(v) > 0)
    return F.when(F.size(some) > 0, some)


def presence_counts(words: Column) -> Column:
    """Each distinct word with the count 1."""
    w = F.array_distinct(words)
    return F.map_from_arrays(w, F.array_repeat(F.lit(1), F.size(w)))


def long_words(words: Column, n: int) -> Column:
    return F.filter(words, lambda w: F.char_length(F.trim(w)) >= n)


def leftovers(items: Column, used: Column) -> Column:
    """Items that were not used, in their order."""
    return F.array_except(items, used)


def label_ids(types: DataFrame, kind: str = "type") -> DataFrame:
    """(label, id): O is 0, then B- and I- of each type in sorted order."""
    one = types.where(F.col(kind).isNotNull()).agg(F.array_sort(F.collect_set(kind)).alias("t"))
    pairs = F.flatten(F.transform(F.col("t"), lambda t: F.array(F.concat(F.lit("B-"), t), F.concat(F.lit("I-"), t))))
    return one.select(F.posexplode(F.concat(F.array(F.lit("O")), pairs)).alias("id", "label")).select("label", "id")


def map_rows(df: DataFrame, text: str, value_schema: str) -> DataFrame:
    """(key, the fields of its struct) of a column of JSON objects of objects."""
    parsed = F.from_json(F.col(text), f"map<string, {value_schema}>")
    return df.select(F.explode(parsed).alias("key", "value")).select("key", "value.*")
