"""Column functions on strings: analyzers, predicates, similarity, replies of language models, logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .links import strip

TOKEN = r"[\p{L}\p{N}]+"
#: Runs of letters and digits, but every CJK character is a token of its own.
STANDARD = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[\p{L}\p{N}&&[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]]+"
# Field marks in a language model's reply, and the artefact of machine translation.
REPLY_FIELDS = ("英文别名", "中文别名", "中文定义", "英文定义", "中文详细描述", "英文详细描述", "标签")
ARTEFACT = "I don't think so"
#: Sample of characters whose traditional and simplified forms differ; a full table is a parameter.
SIMPLIFIED = dict(zip("國軍戰機導彈飛艦車東風龍華門馬長發電動實體語學會時間", "国军战机导弹飞舰车东风龙华门马长发电动实体语学会时间", strict=True))


def tokens(text: Column) -> Column:
    """Plain analyzer: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def standard_tokens(text: Column) -> Column:
    """Standard analyzer: as ``tokens``, CJK text as single characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(STANDARD), F.lit(0))


def bigram_tokens(text: Column) -> Column:
    """Search-side analyzer: pairs of neighbouring standard tokens; a text of one token is that token."""
    t = standard_tokens(text)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda x, y: F.concat(x, y))
    return F.when(F.size(t) < 2, t).otherwise(pairs)


def preprocess_query(text: Column) -> Column:
    """Every run of white space, ideographic spaces included, becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truthy(c: Column) -> Column:
    """Null for an empty string, so that ``coalesce`` takes the next one."""
    return F.nullif(c, F.lit(""))


def first_truthy(*columns: Column, default: str | None = "") -> Column:
    return F.coalesce(*[truthy(c) for c in columns], F.lit(default))


def min_length(text: Column, n: int) -> Column:
    """True for a text of at least ``n`` characters without its outer white space; never null."""
    return F.coalesce(F.char_length(strip(text)) >= n, F.lit(False))


def head(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.left(text, F.lit(n))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def to_simplified(text: Column, table: Mapping[str, str] = SIMPLIFIED) -> Column:
    """Traditional characters replaced by the simplified ones of ``table``."""
    return F.translate(text, "".join(table), "".join(table.values()))


def to_traditional(text: Column, table: Mapping[str, str] = SIMPLIFIED) -> Column:
    return F.translate(text, "".join(table.values()), "".join(table))


def simplified_aliases(aliases: Column, table: Mapping[str, str] = SIMPLIFIED) -> Column:
    """Every alias simplified; of aliases that become equal the first stays."""
    return F.array_distinct(F.transform(aliases, lambda a: to_simplified(a, table)))


def is_traditional(text: Column, table: Mapping[str, str] = SIMPLIFIED) -> Column:
    """True if turning the text traditional changes nothing."""
    return text == to_traditional(text, table)


def is_chinese(text: Column, language: Column) -> Column:
    """True for a text identified as zh that holds any character beyond ASCII."""
    return (language == "zh") & text.rlike(r"[^\x00-\x7F]")


def containment(a: Column, b: Column) -> Column:
    """1 for equal strings without regard to case; the length ratio if one contains the other; else 0, as for empty strings."""
    x, y = F.lower(a), F.lower(b)
    ratio = F.least(F.char_length(x), F.char_length(y)) / F.greatest(F.char_length(x), F.char_length(y))
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(some & (x == y), 1.0).when(some & (x.contains(y) | y.contains(x)), ratio).otherwise(0.0)


def embedding_text(label: Column, aliases: Column) -> Column:
    """Label and aliases in one line, empty ones left out."""
    return F.array_join(F.filter(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def reply_field(reply: Column, field: str, default: str = "") -> Column:
    """The value after ``field`` and a colon (a full-width one is looked for first), up to the next field mark or blank line."""
    end = "|".join([*REPLY_FIELDS, r"\n\n"])
    value = lambda colon: strip(F.regexp_extract(reply, rf"(?s)^.*?{field}{colon}(.*?)(?:{end}|$)(?=.*$)", 1))
    found = F.when(reply.contains(f"{field}："), value("：")).when(reply.contains(f"{field}:"), value(":"))
    return F.coalesce(truthy(found), F.lit(default))


def candidate_option(number: Column, candidate: Column) -> Column:
    """One candidate (label, aliases_zh, aliases_en, descriptions_zh, descriptions_en, link) as an option of a ranking prompt."""
    some = lambda c, none: F.coalesce(truthy(c), F.lit(none))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    joined = lambda f: some(F.array_join(candidate[f], ", "), "无")
    return F.concat(
        F.lit("选项"), number.cast("string"), F.lit("：\n"), line("label", F.coalesce(candidate["label"], F.lit(""))),
        line("aliases_zh", joined("aliases_zh")), line("aliases_en", joined("aliases_en")),
        line("descriptions_zh", some(candidate["descriptions_zh"], "（无描述信息）")), line("descriptions_en", some(candidate["descriptions_en"], "（无描述信息）")),
        line("link", F.coalesce(candidate["link"], F.lit(""))))


def ranking_prompt(query: Column, candidates: Column, *, from_vectors: bool) -> Column:
    """What a language model is asked: rank the candidates (array of structs) by how well their descriptions fit the query."""
    note = "vector search" if from_vectors else "text search; ignore similarity scores"
    options = F.array_join(F.transform(candidates, lambda c, i: candidate_option(i + 1, c)), "")
    return F.concat(
        F.lit("Rank the options by how well their descriptions fit the query. Source of the options: " + note + ".\nQuery: "), query, F.lit("\n"), options,
        F.lit("Answer with all "), F.size(candidates).cast("string"), F.lit(" links, each once, one a line, best first, nothing else."))


def log_number(log: Column, name: str) -> Column:
    """The number after ``name`` and a colon of either width, thousands separators dropped."""
    return F.replace(F.nullif(F.regexp_extract(log, rf"{name}[：:]\s*([\d,]*\.?\d+)", 1), F.lit("")), F.lit(","), F.lit("")).cast("double")


def log_ratio(log: Column, name: str) -> Column:
    """Both numbers of ``name: a/b``."""
    part = lambda i: F.nullif(F.regexp_extract(log, rf"{name}[：:]\s*(\d+)/(\d+)", i), F.lit("")).cast("long")
    return F.struct(part(1).alias("done"), part(2).alias("total"))


def is_progress_line(line: Column) -> Column:
    """True for progress bars that report no loss, epoch or learning rate."""
    return line.rlike(r"\d+%\s*\|") & line.rlike(r"\|\s*\d+/\d+") & ~line.rlike(r"(?i)loss|epoch|learning_rate")
