"""Table access and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The standard analyzer in DuckDB's regular expressions.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
STANDARD = r"regexp_extract_all(regexp_replace(lower({}), '([" + CJK.replace("{", "{{").replace("}", "}}") + r"])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def article(page_id: Column, url: Column) -> Column:
    """Stand-in for links of many forms: two of three pages get an article link with escapes, a plus and the page's own suffix."""
    own = F.regexp_extract(url, r"[?#].*$", 0)
    return F.when(page_id % 3 == 0, F.concat(F.lit("  "), url, F.lit(" "))).when(
        page_id % 3 == 1, F.concat(F.lit("https://zh.wikipedia.org/wiki/%E9%98%BF_"), page_id.cast("string"), F.lit("+B%20c"), own)).otherwise(
        F.concat(F.lit("https://en.wikipedia.org/wiki/T/"), page_id.cast("string"), own))


ARTICLE = r"""CASE WHEN page_id % 3 = 0 THEN '  ' || url || ' '
  WHEN page_id % 3 = 1 THEN 'https://zh.wikipedia.org/wiki/%E9%98%BF_' || page_id || '+B%20c' || regexp_extract(url, '[?#].*$')
  ELSE 'https://en.wikipedia.org/wiki/T/' || page_id || regexp_extract(url, '[?#].*$') END"""


def normal(link: str, version: int) -> str:
    """SQL of a link's normal form."""
    title = f"substr({link}, strpos({link}, '/wiki/') + 6)"
    if version == 2:
        title = f"split_part(split_part({title}, '#', 1), '?', 1)"
    return f"CASE WHEN contains({link}, 'wikipedia.org/wiki/') THEN url_decode({title}) ELSE trim({link}) END"
