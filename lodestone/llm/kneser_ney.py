"""Interpolated modified Kneser-Ney bigram models by sharded count joins.

A model is a table. Its counts cover all training text, are added up in each batch before the
shuffle, and never reach the driver; only counts of counts and totals do. A bigram's probability
is its discounted share of its context plus the context's back-off weight times the word's
probability, which is the discounted share of its continuation count plus, for unknown words, a uniform part.
In logarithms that is additive: the log-likelihood of a text is the sum of one weight per token (the word's
probability plus its back-off weight as a context) and one per bigram that the model has seen (what it
gains over backing off). Scoring is one join of n-gram hashes against that table and one sum by document.

Counting and scoring go through the n-grams in ``parts`` slices of the hash space; a slice's shuffle
files go before the next is cut, so the disk holds a slice at a time, at any size of the corpus. N-grams that
leave the documents are those of the model that a fixed-size bitmap lets through (without loss; a full one
lets everything through), and the HOT most frequent ones are scored where the documents lie, so that no
common word or expression makes a hot key.

``independent``: each class is a model of its own, and every document names the one that judges it. ``contrast``: two
classes share their back-off: a word's class probability leans on the common one, a bigram's on the common
discounted share times the word's ratio, by ``prior`` and ``pair_prior`` occurrences; back-off weights are common. The
weights are then differences of logarithms, and word probabilities are normalised.

Words are runs of letters, digits and underscores, lower-cased; a text is closed by a boundary that
is also the first context, so an empty or null text is the boundary alone. Words are known by 64-bit hashes, n-grams by 61-bit ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, stored

WORD = re.compile(r"\w+")
BOUNDARY, TURN, MARKS = 1, 21, 7
HOT, BITS = 500_000, 27


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(document, word hash), each document closed by the boundary."""
    words, n = [], []
    for t in texts:
        found = WORD.findall(t.lower()) if t else []
        words += found
        n.append(len(found) + 1)
    ends = np.cumsum(n) - 1
    out = np.full(int(ends[-1]) + 1 if n else 0, BOUNDARY, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends if n else []] = False
    out[inner] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.repeat(np.arange(len(texts)), n), out


def contexts(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The word before each token; before the first one, the boundary."""
    return np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.uint64(BOUNDARY), np.concatenate([h[:1], h[:-1]]))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both words' hashes are uniform; turning one makes the order count. ``pair_key`` is the same in SQL."""
    return ((v << np.uint64(TURN)) | (v >> np.uint64(64 - TURN))) ^ w


def pair_key(v: Column, w: Column) -> Column:
    return F.shiftleft(v, TURN).bitwiseOR(F.shiftrightunsigned(v, 64 - TURN)).bitwiseXOR(w)


def marked(key, of):
    """An n-gram's key in the model ``of`` (a small number)."""
    if isinstance(key, Column):
        return key.bitwiseAND(F.lit(~MARKS)).bitwiseOR(F.lit(of))
    return (key & np.uint64(~np.uint64(MARKS))) | of.astype(np.uint64)


def in_part(key, part: int, parts: int):
    if isinstance(key, Column):
        return F.shiftrightunsigned(key, 3) % parts == part
    return (key >> np.uint64(3)) % np.uint64(parts) == np.uint64(part)


def bigram_counts(docs: DataFrame, classes: Sequence[Column], part: int, parts: int) -> DataFrame:
    """(v, w, c0, c1, ...): the bigrams whose context is in ``part``, and how often each class has them."""
    k = len(classes)
    names = [f"c{i}" for i in range(k)]
    schema = "v long, w long, " + ", ".join(f"{c} long" for c in names)
    rows = docs.select("text", *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(classes)]).where(" OR ".join(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            member = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(np.int64)
            for a, b in slices(texts):
                doc, w = tokens(texts[a:b])
                v = contexts(doc, w)
                here = in_part(v, part, parts)
                doc, v, w = doc[here], v[here], w[here]
                _, first, of = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
                count = [np.bincount(of, weights=member[a:b, i][doc], minlength=len(first)).astype(np.int64) for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (v[first], w[first])] + [pa.array(c) for c in count], names=["v", "w", *names])

    found = rows.mapInArrow(run, schema)
    return found.groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in names])


def discounts(n: Sequence[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and above from n1..n4."""
    n1, n2, n3, n4 = (max(float(x or 0), 0.5) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), 0.95 * (i + 1)) for i, d in enumerate(raw))


class Level(NamedTuple):
    """Counts of counts of one order and class: discounts, total, the share that goes to the lower order, and kinds."""

    d: tuple[float, float, float]
    total: float
    mass: float
    kinds: int


def tallies(c: str, p: str) -> list[Column]:
    return [F.count_if(F.col(c) == j).alias(f"{p}_n{j}") for j in (1, 2, 3, 4)] + [
        F.sum(c).alias(f"{p}_total"), F.count_if(F.col(c) >= 3).alias(f"{p}_up"), F.count_if(F.col(c) > 0).alias(f"{p}_kinds")]


def level(row, p: str) -> Level:
    d, total = discounts([row[f"{p}_n{j}"] for j in (1, 2, 3, 4)]), float(row[f"{p}_total"] or 0)
    mass = (d[0] * row[f"{p}_n1"] + d[1] * row[f"{p}_n2"] + d[2] * row[f"{p}_up"]) / total if total else 1.0
    return Level(d, total, mass, row[f"{p}_kinds"])


def cut_by(c: Column, d: tuple[float, float, float]) -> Column:
    """The count less its discount."""
    return F.when(c <= 0, 0.0).when(c == 1, 1 - d[0]).when(c == 2, 2 - d[1]).otherwise(c - F.lit(d[2]))


class Model(NamedTuple):
    """(key, weight, hot) rows in ``parts`` tables, the weight of any token in each model, and the slices."""

    tables: list[DataFrame]
    base: list[float]


def hot_count(histograms: Sequence[DataFrame], most: int) -> int:
    """The least count that fewer than ``most`` n-grams reach; histograms are (n, rows), one row per distinct count."""
    rows = sorted(((r["n"], r["rows"]) for h in histograms for r in h.collect()), reverse=True)
    total = 0
    for n, many in rows:
        total += many
        if total > most:
            return n + 1
    return 1


def train(docs: DataFrame, classes: Sequence[Column], *, contrast: bool = False, prior: float = 20.0, pair_prior: float = 1000.0, parts: int = 2, hot: int = HOT) -> Model | None:
    """The models of ``classes`` (each its own), or with ``contrast`` the first class's log-likelihood less the second's; None without text in each."""
    k = range(len(classes))
    names = [*map(str, k), *(["all"] if contrast else [])]
    # in the order of v, equal contexts lie together in the tables and in the shuffles that read them
    stems = [stored(bigram_counts(docs, classes, p, parts).sortWithinPartitions("v", "w"), "bigrams") for p in range(parts)]
    whole = lambda df: df.withColumn("call", sum(F.col(f"c{i}") for i in k))
    bi = stems[0]
    for s in stems[1:]:
        bi = bi.unionByName(s)
    bi = whole(bi)
    uni = stored(bi.groupBy("w").agg(*[F.count_if(F.col(f"c{i}") > 0).alias(f"u{i}") for i in names]), "unigrams")
    b = bi.agg(*[x for i in names for x in tallies(f"c{i}", f"b{i}")]).first()
    u = uni.agg(F.count(F.lit(1)).alias("words"), *[x for i in names for x in tallies(f"u{i}", f"u{i}")]).first()
    if any(not b[f"b{i}_total"] for i in names):
        return None
    db, du = ({i: level(row, f"{x}{i}") for i in names} for x, row in (("b", b), ("u", u)))
    context = stored(bi.groupBy("v").agg(F.sum("call").alias("n"), *[x for i in names for x in (
        F.sum(f"c{i}").alias(f"t{i}"), *[F.count_if(F.col(f"c{i}") == j).alias(f"x{i}_{j}") for j in (1, 2)], F.count_if(F.col(f"c{i}") >= 3).alias(f"x{i}_3"))]), "contexts")
    histogram = lambda df, n: df.groupBy(F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    least = hot_count([histogram(bi, "call"), histogram(context, "n")], hot)

    def backoff(i: str) -> Column:
        """The share of a context that goes to the lower order; everything, where the class hasn't seen it."""
        kept = sum(F.lit(db[i].d[j - 1]) * F.col(f"x{i}_{j}") for j in (1, 2, 3))
        return F.when(F.col(f"t{i}") > 0, kept / F.col(f"t{i}")).otherwise(1.0)

    def word(i: str, below: Column | float) -> Column:
        return cut_by(F.col(f"u{i}"), du[i].d) / F.lit(du[i].total) + F.lit(du[i].mass) * below

    uniform = {i: 1.0 / (du[i].kinds + 1) for i in names}
    if contrast:
        common = word("all", F.lit(uniform["all"]))
        lean = lambda own, shared, n, p: (own * n + shared * F.lit(p)) / (n + F.lit(p))
        low = uni.select("w", common.alias("pall"), *[lean(word(str(i), common), common, F.col("uall"), prior).alias(f"p{i}") for i in k])
        unseen = du["all"].mass * uniform["all"]
        # word probabilities add up to one, the unknown word's included
        z = low.agg(*[(F.sum(f"p{i}") + F.lit(unseen)).alias(f"z{i}") for i in k]).first()
        low = low.select("w", "pall", *[(F.col(f"p{i}") / F.lit(z[f"z{i}"])).alias(f"p{i}") for i in k])
        base = [float(np.log(z["z1"] / z["z0"]))]
    else:
        low = uni.select("w", *[word(str(i), F.lit(uniform[str(i)])).alias(f"p{i}") for i in k])
        base = [float(np.log(du[str(i)].mass * uniform[str(i)])) for i in k]
    context = context.select("v", "n", *[f"t{i}" for i in names], *[backoff(i).alias(f"l{i}") for i in (["all"] if contrast else names)])
    found = context, uni
    context, low = stored(context, "context-weights"), stored(low, "words")
    for t in found:
        remove(t)

    def rows(key: Column, weights: list[Column], n: Column) -> list[Column]:
        each = [F.struct(marked(key, i).alias("key"), w.cast("float").alias("weight")) for i, w in enumerate(weights)]
        return [F.explode(F.array(*each)).alias("r"), (n >= least).alias("hot")]

    both = low.join(context, F.col("v") == F.col("w"), "full")
    lone = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    if contrast:
        word_weights = [F.log(lone("p0", 1.0)) - F.log(lone("p1", 1.0)) - F.lit(base[0])]
    else:
        word_weights = [F.log(lone(f"p{i}", float(np.exp(base[i])))) - F.lit(base[i]) + F.log(lone(f"l{i}", 1.0)) for i in k]
    words = stored(both.select(*rows(F.coalesce("w", "v"), word_weights, lone("n", 0))).where("r.weight <> 0").select("r.*", "hot"), "word-weights")
    tables = []
    for p, stem in enumerate(stems):
        met = whole(stem.join(context, "v").join(low, "w"))
        if contrast:
            shared = cut_by(F.col("call"), db["all"].d) / F.col("tall")

            def gain(i: int, shared=shared) -> Column:
                own = F.when(F.col(f"t{i}") > 0, cut_by(F.col(f"c{i}"), db[str(i)].d) / F.col(f"t{i}")).otherwise(0.0)
                n = F.col("call")
                seen = (own * n + shared * F.col(f"p{i}") / F.col("pall") * F.lit(pair_prior)) / (n + F.lit(pair_prior))
                return F.log1p(seen / (F.col("lall") * F.col(f"p{i}")))

            weights = [gain(0) - gain(1)]
        else:
            weights = [F.log1p(F.coalesce(F.try_divide(cut_by(F.col(f"c{i}"), db[str(i)].d), F.col(f"t{i}") * F.col(f"l{i}") * F.col(f"p{i}")), F.lit(0.0))) for i in k]
        part = met.select(*rows(pair_key(F.col("v"), F.col("w")), weights, F.col("call"))).where("r.weight <> 0").select("r.*", "hot")
        tables.append(stored(part, f"weights-{p}"))
        remove(stem)
    remove(context)
    remove(low)
    return Model([words, *tables], base)


def bitmap(model: DataFrame) -> np.ndarray:
    """One bit for each value of the keys' low BITS bits: whether the model has a key with them. Its size is fixed."""
    place = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    found = model.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for b, bits in zip(found["b"].to_pylist(), found["bits"], strict=True):
        part = np.frombuffer(bits.as_buffer(), np.uint8)
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part
    return out


def features(docs: DataFrame, shared: Broadcast, part: int, parts: int) -> DataFrame:
    """(key, doc, total, words): a row for each n-gram that may be in the model's ``part``; also one per document, under a
    key of its own, with what the part's hot n-grams weigh, and in the first part with its tokens and what they weigh without further n-grams. ``docs`` are (doc_id, text, which); ``shared`` has each model's
weight of a token, the keys and weights of the hot n-grams, and the bitmap: a few MB, whatever the model's size."""
    schema = "key long, doc long, total double, words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, hot_keys, hot_weights, known = shared.value
        for batch in batches:
            texts, ids, which = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("which").to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                doc, w = tokens(texts[a:b])
                of = which[a:b][doc]
                met = []
                # only this part's n-grams go through the bitmap, the order and the hot ones
                for each in (w, pair_hash(contexts(doc, w), w)):
                    here = np.flatnonzero(in_part(each, part, parts))
                    met.append((marked(each[here], of[here]), doc[here]))
                key, both = (np.concatenate(x) for x in zip(*met, strict=True))
                low = key & np.uint64((1 << BITS) - 1)
                maybe = (known[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
                key, both = key[maybe], both[maybe]
                # in order, keys are looked up in a fraction of the time and make smaller shuffle files
                order = np.argsort(key)
                key, both = key[order], both[order]
                total, local = np.zeros(b - a), np.zeros(len(key), bool)
                if len(hot_keys):
                    at = np.searchsorted(hot_keys, key)
                    at[at == len(hot_keys)] = 0
                    local = hot_keys[at] == key
                    total += np.bincount(both[local], weights=hot_weights[at[local]], minlength=b - a)
                n = np.zeros(b - a, dtype=np.int64)
                if part == 0:
                    n = np.bincount(doc, minlength=b - a)
                    total += n * base[which[a:b]]
                rows = np.flatnonzero((n > 0) | (total != 0))
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                own = w[first] ^ (np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[rows].view(np.int64)), ids.take(pa.array(rows + a)), pa.array(total[rows]), pa.array(n[rows])], names=["key", "doc", "total", "words"])
                key, both = key[~local], both[~local]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), ids.take(pa.array(both + a)), pa.nulls(len(key), pa.float64()), pa.nulls(len(key), pa.int64())], names=["key", "doc", "total", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("which").cast("long").alias("which")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, which: Column | None = None, *, parts: int = 3) -> DataFrame:
    """(doc, total, words) per distinct doc_id: summed weights and tokens, the boundary included. which: the number of the model that judges a document."""
    whole = model.tables[0]
    for t in model.tables[1:]:
        whole = whole.unionByName(t)
    top = whole.where("hot").select("key", "weight").toArrow()
    keys, weights = top["key"].to_numpy().view(np.uint64), top["weight"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    hot = keys[order], weights[order]
    rest = whole.where("NOT hot").select("key", "weight")
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(model.base), *hot, bitmap(whole)))
    asked = docs.select("doc_id", "text", (F.lit(0) if which is None else which).alias("which"))
    sums = []
    for part in range(parts):
        met = features(asked, shared, part, parts).join(rest.where(in_part(F.col("key"), part, parts)), "key", "left")
        sums.append(stored(met.groupBy("doc").agg(F.sum(F.coalesce("total", "weight", F.lit(0.0))).alias("total"), F.sum("words").alias("words")), "scores"))
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    out = stored(out.groupBy("doc").agg(F.sum("total").alias("total"), F.sum("words").alias("words")), "scores-total")
    for t in [*model.tables, *sums]:
        remove(t)
    return out
