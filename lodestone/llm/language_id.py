"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), then
calibrated by a temperature on rows kept out of training. The classifier is fitted on a bounded
sample (``rows_per_language``, ``max_rows``) of labelled rows, taken in the order of a hash of
their ids; scoring covers every row and whole texts. Features live in a hashed space of fixed
size, so the model that goes to the tasks has a fixed size too (``2**BITS * languages``).

Defined results: null text or a text without letters is ``und`` with score 0; without labelled
rows every text is ``und``. Equally likely languages: the first by name. Texts of any length count in whole, in pieces of bounded size. Rows
that repeat are scored alike; extra columns stay; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import process_cache, slices

BITS, ORDERS = 17, 3
MIX = np.uint64(0x9E3779B97F4A7C15)
SCALE = 64.0
#: Characters of a text that are looked at in one go, and those of several texts together: each takes a line of numbers for every language.
PIECE = TOGETHER = 250_000


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    known = process_cache()
    if "letters" not in known:
        table = np.full(0x110000, 32, dtype=np.uint32)
        alpha = [i for i in range(0x110000) if chr(i).isalpha()]
        table[alpha] = alpha
        known["letters"] = table
    return known["letters"]


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts in one array, a space and a zero after each; and where each starts."""
    low = [(t or "").lower() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])])
    raw = np.frombuffer(" \0".join([*low, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(raw == 0, 0, letters()[raw]).astype(np.uint64), starts


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-gram that ends at each position, and where it is within one text."""
    h, ok = codes + np.uint64(1), codes != 0
    first = ok
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = np.concatenate([h[:1], h[:-1] * MIX + codes[1:] + np.uint64(1)])
            ok = np.concatenate([[False], ok[:-1] & first[1:]])
        yield ((h * MIX + np.uint64(n)) * MIX) >> np.uint64(64 - BITS), ok


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their share of its n-grams."""
    codes, _ = code_points([text])
    found = np.concatenate([h[ok] for h, ok in grams(codes)])
    idx, n = np.unique(found.astype(np.int64), return_counts=True)
    return idx, n / max(1, len(found))


class Model:
    """Weights (already times IDF) in the hashed space, the languages, and the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        # a long text goes through in pieces; each starts with the end of the one before, whose n-grams are not counted again, and
        # only the last one ends with the space that closes a text
        pieces = [(i, low[max(0, a - ORDERS + 1) : a + PIECE], min(a, ORDERS - 1), a + PIECE >= len(low)) for i, t in enumerate(texts) if t for low in [t.lower()] for a in range(0, len(low), PIECE)]
        n = len(texts)
        total, has, logits = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros((n, len(self.langs)))
        for a, b in slices([p[1] for p in pieces], TOGETHER):
            of = np.array([p[0] for p in pieces[a:b]])
            codes, starts = code_points([p[1] for p in pieces[a:b]])
            at, again = starts[:-1], np.zeros(len(codes), dtype=bool)
            for s, (_, piece, lead, last) in zip(at, pieces[a:b], strict=True):
                again[s : s + lead] = True
                again[s + len(piece)] |= not last
            np.add.at(has, of, np.add.reduceat(((codes > 32) & ~again).astype(np.int64), at))
            for h, ok in grams(codes):
                ok = ok & ~again
                np.add.at(total, of, np.add.reduceat(ok.astype(np.int64), at))
                picked = self.weights[np.where(ok, h, len(self.weights) - 1).astype(np.int64)]
                np.add.at(logits, of, np.add.reduceat(picked, at, axis=0, dtype=np.float64))
        logits = (logits / np.maximum(total, 1)[:, None] * SCALE + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True)) if len(self.langs) else logits
        p = p / p.sum(1, keepdims=True) if len(self.langs) else p
        known = [bool(self.langs) and has[i] > 0 for i in range(n)]
        names = [self.langs[int(p[i].argmax())] if k else "und" for i, k in enumerate(known)]
        return names, np.array([float(p[i].max()) if k else 0.0 for i, k in enumerate(known)])


def fit(texts: list[str], labels: list[str], *, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 1) -> Model:
    """FTRL-proximal with elastic net; every fifth row calibrates the temperature."""
    langs = sorted(set(labels))
    size = (1 << BITS) + 1  # the last row stands for "no n-gram" and stays zero
    rows = [(*counts(t), langs.index(y)) for t, y in zip(texts, labels, strict=True)]
    train, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    if len(langs) < 2 or not train:
        return Model(langs, np.zeros((size, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    df = np.zeros(size)
    for idx, _, _ in train:
        df[idx] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n, w = (np.zeros((size, len(langs))) for _ in range(3))
    zb, nb, bias = (np.zeros(len(langs)) for _ in range(3))

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            idx, tf, y = train[k]
            x = tf * idf[idx] * SCALE
            w_i = solve(z[idx], n[idx])
            bias = solve(zb, nb)
            g = softmax(x @ w_i + bias)
            g[y] -= 1
            gx = x[:, None] * g
            sigma = (np.sqrt(n[idx] + gx * gx) - np.sqrt(n[idx])) / alpha
            z[idx] += gx - sigma * w_i
            n[idx] += gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w, bias = solve(z, n), solve(zb, nb)
    logits = np.array([(tf * idf[idx] * SCALE) @ w[idx] + bias for idx, tf, _ in held])
    truth = np.array([y for *_, y in held])

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]))

    grid = np.geomspace(0.05, 20, 61)
    best = float(min(grid, key=loss)) if len(held) else 1.0
    return Model(langs, (w * idf[:, None]).astype(np.float32), bias, best)


def training_rows(docs: DataFrame, learnable: Column, *, rows_per_language: int, max_rows: int, max_bytes: int = 64_000_000) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows: ids are picked first, texts follow for these alone. Texts of more than a
    64th of ``max_bytes``, and rows beyond ``max_bytes`` in all, teach nothing; they are judged all the same."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    learnable = learnable & F.col("lang").isNotNull() & (size <= max_bytes // 64)
    ids = docs.where(learnable).select("doc_id", "lang", order.alias("o"), size.cast("long").alias("size"))
    # of a language with many rows only the smallest hashes, three times as many as are picked, go to the task that picks
    often = ids.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), F.lit(3.0 * rows_per_language) / F.count(F.lit(1))).alias("share"))
    low = (F.col("o").cast("double") / F.lit(float(2**64))) + 0.5 <= F.col("share")
    ids = ids.join(F.broadcast(often) if often.count() <= 100_000 else often, F.col("lang") == F.col("of")).where(low).select("doc_id", "lang", "o", "size")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))).where(F.col("r") <= rows_per_language)
    ids = ids.orderBy("r", "lang").limit(max_rows)
    # at most max_rows rows
    ids = ids.withColumn("sum", F.sum("size").over(Window.orderBy("r", "lang", "doc_id"))).where(F.col("sum") <= max_bytes).select("doc_id").distinct()
    got = docs.where(learnable & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    got = got.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(order, "doc_id", "lang", "text").limit(max_rows).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def train(docs: DataFrame, learnable: Column | None = None, *, rows_per_language: int = 800, max_rows: int = 6000) -> Model:
    keep = F.col("doc_id").isNotNull() if learnable is None else F.coalesce(learnable, F.lit(False))
    return fit(*training_rows(docs, keep, rows_per_language=rows_per_language, max_rows=max_rows))


def predictor(spark: SparkSession, model: Model):
    """A column function text -> struct(lang, score)."""
    # plain values: a class would be looked up by name on executors, which need not have this package
    shared = spark.sparkContext.broadcast((model.langs, model.weights, model.bias, model.temperature))

    @F.pandas_udf("lang string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for texts in batches:
            names, scores = model.predict([None if t is None or t != t else t for t in texts.tolist()])
            yield pd.DataFrame({"lang": names, "score": scores})

    return language
