"""Byte-level BPE: ranked merges folded by higher-order functions over the bytes of distinct words.

A text is cut into words by the tokenizer's pattern. A word whose bytes are a token is that token; every other
word starts as the array of its bytes and a fold merges, step after step, the leftmost adjacent pair of lowest rank
until no pair has one. Ranks stand in a literal: an array of small maps, picked by a hash of the token,
because a map is searched from its first key on. Bytes are written as the 256 characters of Latin-1, so a token of any
bytes is a string of as many characters, and decoding joins these and takes their bytes back.

The corpus' frequent distinct words are folded once, as a table of words, and stand in a second literal of
the same form (``cached_words`` of them at most, each of up to 48 bytes, counted in a sample of about ``sample_rows`` documents); all
other words are folded where they stand. The sample decides how fast a word's ids are found and never which ids they are.

Nothing is shuffled but the counts of the sample's words; documents stay where they are read. Everything is column expressions.

Defined results: null text counts as empty and has no ids; an empty table gives an empty table. Special tokens' strings are
ordinary text. A text of any length is encoded whole; the fold's cost grows with the square of the longest *word* (not text).
Rows that repeat are encoded each. Extra columns stay, ids go to the new column last.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Maps in a literal table; with 50,000 to 150,000 keys a map holds about one to three.
BUCKETS = 1 << 16
#: ``xxhash64`` of Spark starts from this seed.
SEED = 42
LONGEST_CACHED = 48


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 token and rank a line), read on the driver: its size is the vocabulary's."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """Java means ASCII by ``\\s`` unless told otherwise; words of letters come first, since no other alternative can begin as they do."""
    letters = r" ?\p{L}+"
    return f"(?U){letters}|{pattern}" if letters in pattern.split("|") else f"(?U){pattern}"


def latin(text: Column) -> Column:
    """The UTF-8 bytes as characters of Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_table(entries: Mapping[str, object], kind: str) -> Column:
    """``entries`` as a literal array of maps; the optimizer folds the parsing away."""
    table: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        table[xxhash.xxh64_intdigest(key.encode(), seed=SEED) & (BUCKETS - 1)][key] = value
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")


def looked_up(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


def folded(word: Column, ranks: Column) -> Column:
    """Ids of a word (in Latin-1) by merging the leftmost pair of lowest rank as long as there is one."""

    def merged(s: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(j: Column) -> Column:
            """Pair j (from 0) becomes one token: its right half goes, and so does its rank; the ranks beside it are looked up anew."""

            def with_pair(t: Column) -> Column:
                return F.struct(
                    F.transform(F.filter(p, lambda _, i: i != j + 1), lambda x, i: F.when(i == j, t).otherwise(x)).alias("p"),
                    F.transform(F.filter(r, lambda _, i: i != j + 1), lambda x, i: F.when(i == j, looked_up(ranks, F.concat(t, F.get(p, j + 2))))
                                .when(i == j - 1, looked_up(ranks, F.concat(F.get(p, j - 1), t))).otherwise(x)).alias("r"))

            return bound(F.concat(F.get(p, j), F.get(p, j + 1)), with_pair)

        # lowest rank first, then leftmost
        first = F.array_min(F.transform(r, lambda x, i: F.shiftleft(x.cast("long"), 32) + i))
        return bound(first, lambda m: F.when(m.isNull(), s).otherwise(bound(m.bitwiseAND(F.lit(2**32 - 1)).cast("int"), at)))

    def fold(p: Column) -> Column:
        pairs = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: looked_up(ranks, F.concat(a, b)))
        steps = F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1)))
        return F.aggregate(steps, F.struct(p.alias("p"), pairs.alias("r")), lambda s, _: merged(s), lambda s: F.transform(s["p"], lambda t: looked_up(ranks, t)))

    return bound(F.split(word, ""), fold)


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def word_ids(word: Column, ranks: Column) -> Column:
    """Ids of a word: its own rank, or the fold's."""
    return bound(latin(word), lambda w: bound(looked_up(ranks, w), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(folded(w, ranks))))


def frequent_words(docs: DataFrame, ranks: Column, pattern: str, count: int, sample_rows: int) -> dict[str, list[int]]:
    """The words that occur most often in a sample, with their ids: ``count`` of at most LONGEST_CACHED bytes, so the driver's share is bounded."""
    rows = docs.count()
    if not rows or not count:
        return {}
    some = docs.select("text") if rows <= sample_rows else docs.select("text").sample(sample_rows / rows, seed=SEED)
    words = some.select(F.explode(words_of(F.col("text"), pattern)).alias("word")).where(F.octet_length("word") <= LONGEST_CACHED)
    top = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(count)
    found = top.repartition(F.col("word")).select("word", bound(ranks, lambda t: word_ids(F.col("word"), t)).alias("ids"))
    return {r["word"]: r["ids"] for r in found.collect()}


def encode(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, *, into: str = "ids", cached_words: int = 150_000, sample_rows: int = 50_000) -> DataFrame:
    """``docs`` and the ids of its ``text`` as an array of int in a new column (``into``, or a name that does not clash)."""
    name, = fresh(docs, into)
    tokens = {token.decode("latin-1"): rank for token, rank in ranks.items()}
    table = literal_table(tokens, "int")
    known = frequent_words(docs, table, pattern, cached_words, sample_rows)
    cache = literal_table(known, "array<int>")

    def ids(t: Column) -> Column:
        def with_tables(c: Column) -> Column:
            return F.flatten(F.transform(words_of(F.col("text"), pattern), lambda w: bound(
                looked_up(c, w), lambda found: F.when(found.isNotNull(), found).otherwise(word_ids(w, t)))))

        return bound(cache, with_tables)

    return docs.withColumn(name, bound(table, ids))


def decode(ids: Column, ranks: Mapping[bytes, int]) -> Column:
    """The bytes that ids stand for; null for null ids."""
    tokens = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.decode("latin-1")
    pieces = F.from_json(F.lit(json.dumps(tokens, ensure_ascii=False)), "array<string>")
    return bound(pieces, lambda t: F.encode(F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""), "ISO-8859-1"))
