"""Model calls as column functions. The models are parameters; the defaults are small, deterministic and need no download.

A model is created once per Python worker from what its factory returns and is called with Arrow batches, never row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and of character pairs into ``dim`` components."""

    def __init__(self, dim: int = 1024, most_tokens: int = 512):
        self.dim, self.most = dim, most_tokens

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()[: self.most]
            for piece in [*words, *(f"\0{w[i : i + 2]}" for w in words for i in range(len(w) - 1))]:
                h = zlib.crc32(piece.encode())
                row[h % self.dim] += 1.0 if h & 0x10000 else -1.0
        return out


def embed(make: Callable[[], Embedder] = HashingEmbedder, *, dim: int | None = 1024, normalize: bool = True, batch: int = 256):
    """A column function text -> array<float>: null for null and blank texts, padded or cut to ``dim``, of length 1 if ``normalize``."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                v = np.asarray(model([texts.iloc[i] for i in part]), dtype=np.float64)
                if dim is not None:
                    v = np.pad(v, ((0, 0), (0, max(0, dim - v.shape[1]))))[:, :dim]
                if normalize:
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.where(n > 0, v / np.where(n > 0, n, 1), np.nan)
                for i, row in zip(part, v, strict=True):
                    out[i] = None if np.isnan(row).any() else row.astype(np.float32)
            yield pd.Series(out, dtype=object)

    return run


def embed_words(make: Callable[[], Embedder] = HashingEmbedder, *, merge: str = "mean"):
    """A column function array of words -> array<float>: the words' unit vectors merged by mean, max or sum, and normalised; null without words."""
    how = {"mean": np.mean, "max": np.max, "sum": np.sum}[merge]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for lists in batches:
            rows = [[w for w in (x if x is not None else []) if isinstance(w, str) and w.strip()] for x in lists]
            known = sorted({w for r in rows for w in r})
            v = np.asarray(model(known), dtype=np.float64) if known else np.zeros((0, 1))
            n = np.linalg.norm(v, axis=1, keepdims=True)
            place, v = {w: i for i, w in enumerate(known)}, v / np.where(n > 0, n, 1)
            out: list = []
            for r in rows:
                x = how(v[[place[w] for w in r]], axis=0) if r else np.zeros(1)
                size = float(np.linalg.norm(x))
                out.append((x / size).astype(np.float32) if size > 0 else None)
            yield pd.Series(out, dtype=object)

    return run


class Gazetteer:
    """Tags the longest listed names, B- and I- by character, left to right."""

    def __init__(self, names: Mapping[str, str]):
        self.names = dict(names)
        self.lengths = sorted({len(n) for n in names if n}, reverse=True)

    def __call__(self, text: str) -> list[str]:
        tags, i = ["O"] * len(text), 0
        while i < len(text):
            size = next((n for n in self.lengths if i + n <= len(text) and text[i : i + n] in self.names), 0)
            if size:
                kind = self.names[text[i : i + size]]
                tags[i : i + size] = [f"B-{kind}", *[f"I-{kind}"] * (size - 1)]
            i += size or 1
        return tags


def tag(make: Callable[[], Callable[[str], list[str]]]):
    """A column function text -> array of tags, one per character; empty for null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()
        for texts in batches:
            yield pd.Series([tagger(t) if isinstance(t, str) else [] for t in texts], dtype=object)

    return run


def translate(words: Column, dictionary: Mapping[str, str]) -> Column:
    """Each word of an array that the dictionary holds, translated, in order; without the artefact phrases of machine translation."""
    pairs = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv]) if dictionary else F.create_map().cast("map<string,string>")
    out = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.try_element_at(pairs, w))
    return F.filter(out, lambda w: w.isNotNull() & ~w.contains(T.ARTEFACT))


def expand(mention: Column, known: Mapping[str, str]) -> Column:
    """What is known about a mention, in the form of a language model's reply; empty if nothing is."""
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, mention), F.lit(""))


def rerank(hits: DataFrame, docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query: Column) -> DataFrame:
    """(query_id, id, rank): hits (query_id, id, rank) ordered by the share of the query's words that their text holds; ties, and queries
    without words, keep the order of the input."""
    words = queries.select("query_id", F.array_distinct(T.standard_tokens(query)).alias("_q"))
    body = docs.select(F.col(id_col).alias("id"), T.standard_tokens(text).alias("_t"))
    both = hits.select("query_id", "id", "rank").join(words, "query_id", "left").join(body, "id", "left")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_q", "_t")), F.size("_q")), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_share"), "rank", "id"))
    return both.withColumn("_share", share).select("query_id", "id", place.alias("rank"))
