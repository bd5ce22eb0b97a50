"""BIO annotations: spans to tags and back, entity words, statistics. Everything is one expression per record, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import arrays as A
from ..functions.parts import small_parts

SPAN = "struct<start:int,end:int,type:string>"


def valid_spans(spans: Column, length: Column) -> Column:
    """Spans with 0 <= start < end <= length."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= length))


def encode_spans(text: Column, spans: Column) -> Column:
    """One tag per character from an array of (start, end, type): a later span overwrites what it covers, a span
    without a type is an ``ENTITY``, spans that don't fit the text are ignored."""
    size = F.char_length(text)
    fit = valid_spans(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), size)
    kind = lambda s: F.coalesce(F.nullif(s["type"], F.lit("")), F.lit("ENTITY"))

    def tag(i: Column) -> Column:
        last = F.element_at(F.filter(fit, lambda s: (s["start"] <= i) & (i < s["end"])), -1)
        return F.concat(F.when(last["start"] == i, "B-").otherwise("I-"), kind(last))

    covered = lambda i: F.exists(fit, lambda s: (s["start"] <= i) & (i < s["end"]))
    tags = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(covered(i), tag(i)).otherwise("O"))
    return F.when(size > 0, tags).otherwise(A.no_strings())


def encode_kinds(kinds: Column) -> Column:
    """Tags from an array of kinds (null: none): B- where a kind starts, I- where it goes on."""
    # shifted by one, not looked up by position: a lookup would evaluate the whole array for each of its items
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(kinds, F.lit(1), F.greatest(F.size(kinds) - 1, F.lit(0))))
    return F.slice(F.zip_with(kinds, before, lambda k, b: F.when(k.isNull(), "O").when(
        k.eqNullSafe(b), F.concat(F.lit("I-"), k)).otherwise(F.concat(F.lit("B-"), k))), F.lit(1), F.size(kinds))


def decode(tags: Column, min_length: int = 2, tokens: Column | None = None) -> Column:
    """Array of (start, length, type) of the entities of an array of tags.

    B- opens an entity, I- of the same type goes on with it, anything else closes it; a stray I- is no entity.
    Entities of less than ``min_length`` characters are dropped: where the tags are not of single characters, ``tokens`` are what they are of
    (``##`` marks a continuation and does not count).
    """
    # tags with their positions in one line: a run is then one match
    line = F.array_join(F.transform(tags, lambda t, i: F.concat(i.cast("string"), F.lit(":"), F.coalesce(t, F.lit("O")))), " ")
    runs = F.regexp_extract_all(line, F.lit(r"(?<!\S)\d+:B-(\S+)(?: \d+:I-\1(?!\S))*+"), F.lit(0))
    entity = F.transform(runs, lambda r: F.struct(
        F.regexp_extract(r, r"^(\d+):", 1).cast("int").alias("start"), F.size(F.split(r, " ")).alias("length"),
        F.regexp_extract(r, r"^\d+:B-(\S+)", 1).alias("type")))
    if tokens is None:
        return F.filter(entity, lambda e: e["length"] >= min_length)
    size = lambda e: F.aggregate(F.slice(tokens, e["start"] + 1, e["length"]), F.lit(0), lambda n, t: n + F.char_length(F.replace(F.coalesce(t, F.lit("")), F.lit("##"), F.lit(""))))
    return F.filter(entity, lambda e: size(e) >= min_length)


def entity_words(text: Column, tags: Column, min_length: int = 2) -> Column:
    """The distinct texts of the decoded entities, in order of their first occurrence."""
    return F.array_distinct(F.transform(decode(tags, min_length), lambda e: F.substring(text, e["start"] + 1, e["length"])))


def statistics(examples: DataFrame, tags: str = "labels") -> DataFrame:
    """One row: samples, entities (B- tags), distinct types over all tags, entities per sample."""
    t = F.col(tags)
    kinds = F.array_distinct(F.transform(F.filter(t, lambda x: x.rlike("^[BI]-.")), lambda x: F.substring(x, 3, 1_000)))
    rows = examples.select(F.size(F.filter(t, lambda x: x.startswith("B-"))).alias("n"), kinds.alias("kinds"))
    types = rows.select(F.explode("kinds").alias("k")).agg(F.count_distinct("k").alias("entity_types"))
    one = rows.agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("per_sample"))
    return one.join(F.broadcast(types))


def type_counts(examples: DataFrame, tags: str = "labels", k: int = 10) -> DataFrame:
    """(type, mentions) of the k most frequent types by B- tags; ties by name."""
    kinds = examples.select(F.explode(tags).alias("t")).where("t LIKE 'B-_%'").groupBy(F.substring("t", 3, 1_000).alias("type"))
    return kinds.agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "type").limit(k)


def usable_validation(examples: DataFrame, tags: str = "labels") -> DataFrame:
    """``examples`` if any tag of any row is not O, else none of them."""
    some = examples.agg(F.max(F.exists(tags, lambda x: x != "O")).alias("some")).where("some")
    return examples.join(F.broadcast(some.select(F.lit(1).alias("one"))), how="left_semi")


# Tokens that stand for no text, the marks of continued and leading pieces, and how far and how near a token is looked for.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "<pad>", "<s>", "</s>", "[UNK]")
PIECE_MARKS = ("##", "▁")
BACK, AHEAD, NEAR = 20, 50, 10


def align_tokens(text: str, tokens: Sequence[str], tags: int) -> list[int | None]:
    """The character whose tag each token takes, None for no tag; ``tags``: how many characters have one.

    A token is looked for from BACK before to AHEAD behind the place where the last one ended; of its occurrences the first that is nearer than NEAR
    counts, else the last. One that isn't found takes the character at that place, and the place moves on by one. ``##`` pieces do not move it.
    """
    out: list[int | None] = []
    at = 0
    for token in tokens:
        piece = token
        for mark in PIECE_MARKS:
            piece = piece.replace(mark, "")
        piece = piece.strip()
        if token in SPECIAL_TOKENS or not piece:
            out.append(None)
            continue
        found, stop = -1, min(len(text), at + AHEAD)
        # not beyond the last place that counts: the rest of a long text is not searched for each of its tokens
        end = stop - 1 + len(piece)
        start = text.find(piece, max(0, at - BACK), end)
        while 0 <= start < stop:
            found = start
            if abs(start - at) < NEAR:
                break
            start = text.find(piece, start + 1, end)
        place, moves = (found, len(piece)) if found >= 0 else (at, 1)
        out.append(place if place < tags else None)
        if place < tags and not token.startswith("##"):
            at = place + moves if found >= 0 else min(at + 1, len(text))
    return out


def token_tags(tokens: Column, text: Column, tags: Column) -> Column:
    """The tags of characters carried over to tokens by ``align_tokens``; O for a token without one."""
    return _token_tags(text, tokens, tags)


@F.arrow_udf(ArrayType(StringType()))
def _token_tags(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    # tags are taken by their places and never become Python values
    for text, tokens, tags in batches:
        for texts, words, marks in small_parts([text, tokens, tags]):
            known = pc.is_valid(texts).to_numpy(zero_copy_only=False) & pc.is_valid(words).to_numpy(zero_copy_only=False) & pc.is_valid(marks).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)])
            ends, places = [0], []
            for i, (t, w) in enumerate(zip(texts.to_pylist(), words.to_pylist(), strict=True)):
                if known[i]:
                    places += [None if p is None else int(start[i]) + p for p in align_tokens(t, w, int(size[i]))]
                ends.append(len(places))
            at = pa.array(places, pa.int64())
            taken = pc.if_else(pc.is_valid(at), marks.flatten().take(at), "O")
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.cast(pa.string()), mask=pa.array(~known))
