"""Assembling entity records: one schema for all spellings of a field, alias completion, index documents with vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import links as L
from ..functions import text as X
from ..functions import vector as V
from . import models

# The names under which a field occurs, the first filled one counts.
LABELS = ("label", "itemLabel.value", "itemLabel", "name", "title", "entity_name", "entityLabel.value", "entityLabel")
LINKS = ("link", "wikipedia", "wikipediaLink", "wikipediaLink_zh", "wikipediaLink_en")
LISTS = {"aliases_zh": ("zh_aliases", "aliases_zh"), "aliases_en": ("en_aliases", "aliases_en")}
TEXTS = {"descriptions_zh": ("zh_description", "descriptions_zh"), "descriptions_en": ("en_description", "descriptions_en"), "content": ("content",)}
WORDS = {"entity_words_zh": ("_entity_words_zh", "_high_freq_words_zh"), "entity_words_en": ("_entity_words_en", "_high_freq_words_en")}
DESCRIBED = 10
HEAD, VECTOR_HEAD = 500, 5000


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """The column of a dotted path and its type, if ``df`` has it."""
    kind: T.DataType = df.schema
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return None
        kind = kind[step].dataType
    return F.col(path), kind


def first_text(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [f for n in names if (f := field(df, n))]
    return X.first_truthy(*[c for c, t in found if isinstance(t, T.StringType)])


def first_list(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-empty list; a string counts as a list of one."""
    found = [f for n in names if (f := field(df, n))]
    lists = [c if isinstance(t, T.ArrayType) else A.list_of(c) for c, t in found]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in lists], A.no_strings())


def canonical(df: DataFrame) -> DataFrame:
    """label, link, aliases, descriptions, content and entity words under one name each, however ``df`` spells them."""
    return df.select(
        first_text(df, LABELS).alias("label"), first_text(df, LINKS).alias("link"), *[first_list(df, v).alias(k) for k, v in (LISTS | WORDS).items()],
        *[first_text(df, v).alias(k) for k, v in TEXTS.items()])


def relink_document(df: DataFrame) -> DataFrame:
    return df.select(F.col("link").alias("relink_url"), F.col("content").alias("relink_data"))


def image_document(df: DataFrame) -> DataFrame:
    return df.select(F.col("link").alias("image_url"), F.col("content").alias("image_data"))


def complete_aliases(df: DataFrame, label: Column, zh_en: Mapping[str, str], en_zh: Mapping[str, str]) -> DataFrame:
    """``df`` (zh_aliases, en_aliases): en gains the label and the translated zh aliases, then zh the translations of all en aliases."""
    none = A.no_strings()
    en = F.array_union(F.coalesce("en_aliases", none), F.array(label))
    out = df.withColumn("en_aliases", F.array_union(en, models.translate(F.col("zh_aliases"), zh_en)))
    return out.withColumn("zh_aliases", F.array_union(F.coalesce("zh_aliases", none), models.translate(F.col("en_aliases"), en_zh)))


def backfill_zh(df: DataFrame, en_zh: Mapping[str, str]) -> DataFrame:
    """Records without zh aliases get the translations of their en aliases."""
    have = F.coalesce("zh_aliases", A.no_strings())
    return df.withColumn("zh_aliases", F.when(F.size(have) > 0, have).otherwise(F.array_distinct(models.translate(F.col("en_aliases"), en_zh))))


def complete_record(df: DataFrame, label: Column, content: Column, description: Column, zh_en: Mapping[str, str], en_zh: Mapping[str, str]) -> DataFrame:
    """``df`` with aliases of both languages from each other as they came in, its content if it had none, and a simplified description."""
    none = A.no_strings()
    zh, en = F.coalesce("zh_aliases", none), F.coalesce("en_aliases", none)
    more_zh = F.array_union(zh, F.array_union(F.array(X.to_simplified(label)), models.translate(en, en_zh)))
    more_en = F.array_union(en, models.translate(zh, zh_en))
    return df.withColumns({"zh_aliases": more_zh, "en_aliases": more_en, "content": content, "description_zh": X.to_simplified(description)})


def entity_words(df: DataFrame, tagger: Callable[[Column], Column], *, zh_min: int = 2, en_min: int = 3, text_min: int = 2) -> DataFrame:
    """``df`` (canonical) with the entity words of its descriptions, their frequency maps and counts."""
    from . import annotation

    out = df
    for lang, least in (("zh", zh_min), ("en", en_min)):
        text = F.col(f"descriptions_{lang}")
        words = A.long_words(annotation.entity_words(text, tagger(text)), least)
        words = F.when(X.min_length(text, text_min), words).otherwise(A.no_strings())
        out = out.withColumn(f"entity_words_{lang}", words)
        out = out.withColumn(f"entity_freq_{lang}", A.presence_counts(F.col(f"entity_words_{lang}"))).withColumn(f"entity_count_{lang}", F.size(f"entity_words_{lang}"))
    return out.withColumn("entity_count_total", F.col("entity_count_zh") + F.col("entity_count_en"))


def entity_document(df: DataFrame, embed: Callable[[Column], Column], embed_words: Callable[[Column], Column], dim: int = 1024) -> DataFrame:
    """Canonical records with their seven vectors; a vector is null where there is no text for it or it has another size.

    Entity words count as the normalised mean of their own vectors.
    """
    described = lambda c: F.when(X.min_length(F.col(c), DESCRIBED + 1), F.col(c))
    vectors = {
        "label_vector": embed(X.truthy(F.col("label"))), "label_zh_vector": embed(X.embedding_text(F.col("label"), F.col("aliases_zh"))),
        "label_en_vector": embed(X.embedding_text(F.col("label"), F.col("aliases_en"))), "descriptions_zh_vector": embed(described("descriptions_zh")),
        "descriptions_en_vector": embed(described("descriptions_en")), "entity_words_zh_vector": embed_words(F.col("entity_words_zh")),
        "entity_words_en_vector": embed_words(F.col("entity_words_en"))}
    return df.withColumns(vectors).withColumns({k: F.when(V.has_dim(F.col(k), dim), F.col(k)) for k in vectors})


def page_document(df: DataFrame, embed: Callable[[Column], Column], dim: int = 1024) -> DataFrame:
    """Index documents from page texts (query, link, content): the first 500 characters describe, the first 5,000 are embedded."""
    content, sized = F.coalesce("content", F.lit("")), lambda v: F.when(V.has_dim(v, dim), v)
    out = df.where(X.min_length(F.col("link"), 1) & X.min_length(F.col("content"), 1)).select(
        F.coalesce("query", F.lit("")).alias("label"), "link", content.alias("content"), A.no_strings().alias("aliases_zh"), A.no_strings().alias("aliases_en"),
        X.head(content, HEAD).alias("descriptions_zh"), F.lit("").alias("descriptions_en"))
    long = X.min_length(F.col("content"), DESCRIBED + 1)
    return out.withColumns({
        "label_vector": sized(embed(X.truthy(F.col("label")))), "content_vector": sized(embed(F.when(long, X.head(F.col("content"), VECTOR_HEAD)))),
        "descriptions_zh_vector": sized(embed(F.when(long, F.col("descriptions_zh"))))})


def first_document(df: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The early form of an index document: simplified label and description where they hold CJK, description vectors of both languages."""
    simple = lambda c: F.when(X.has_cjk(F.col(c)), X.to_simplified(F.col(c))).otherwise(F.col(c))
    out = canonical(df)
    out = out.withColumns({"label": simple("label"), "aliases_zh": X.simplified_aliases(F.col("aliases_zh")), "descriptions_zh": simple("descriptions_zh")})
    return description_vectors(out, embed)


def description_vectors(df: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({f"descriptions_{x}_vector": embed(X.truthy(F.col(f"descriptions_{x}"))) for x in ("zh", "en")})


def download_tasks(df: DataFrame) -> DataFrame:
    """(label, link, lang): one row per filled article link of an entity, the zh one first."""
    wide = df.select("label", F.col("wikipediaLink_zh").alias("zh"), F.col("wikipediaLink_en").alias("en"))
    return wide.unpivot("label", ["zh", "en"], "lang", "link").where(F.coalesce("link", F.lit("")) != "").select("label", "link", "lang")


def pages_to_fetch(links: DataFrame, done: DataFrame, link: str = "link") -> DataFrame:
    """Distinct links that lead to text pages of either language and are not yet done."""
    c = F.col(link)
    wanted = links.where(L.page_language(c).isNotNull() & ~L.is_special_page(c) & ~L.is_image_page(c)).select(c).distinct()
    return wanted.join(done.select(c), link, "left_anti")
