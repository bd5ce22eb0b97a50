"""Lexical retrieval packing: a sharded BM25 index chooses which documents share a window.

Documents that share rare pieces are brought together first: a weighted min-hash of its ids puts a document into
one of BINS bins, and bins are dealt to shards of about ``shard_tokens`` ids; a bin that is larger, for instance of
copies, is spread over several shards by a hash of the whole row, so a shard is bounded and no key can make one hot. Document
frequencies and mean length are those of the whole corpus (a table bounded by the vocabulary). Each shard is indexed (BM25
over token ids) and packed; neighbours are looked for in the seed's own shard. The document that opens a window
is its seed, and when it is used up its unused neighbours by all of its terms (but the end id), best
first, fill the window for as long as any scores above zero; the last one is cut and its rest opens
the next window. Every window is full except the last of each shard.

Tokens are those of the given tokenizer. Where its merges can be read as byte ranks without changing an id (``merge_ranks``
checks that), texts are encoded by these ranks; texts with added tokens or very long white space, and all texts
of other tokenizers, go through the tokenizer itself.

Defined results: null text is empty, and every document ends with id 0, so an empty document has
one token. Every character of a text is encoded, NUL included. A text of any length is cut into as many
windows as it fills. Neighbours that score alike are taken in the order of (doc_id, tokens), null ids last. Rows
that repeat are packed as often as they occur. Extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, process_cache, slices, stored

WINDOW, END = 1024, 0
K1, B = 1.2, 0.75
TOKENS = "doc_id long, tokens binary, bin int, df binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: How byte-level tokenizers split a text, and the same where no two characters of white space meet, which needs no look-ahead.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The look-ahead's stack overflows on runs of about a million.
LONG_RUN = re.compile(r"\s{1000}")
#: Lexical keys of documents are counted in so many bins.
BINS = 1 << 18
SHARDS_A_TASK = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(tokenizer, described: dict) -> dict[bytes, int] | None:
    """The bytes of each token and its id, if lowest-rank merging by them gives the tokenizer's own ids for every text; else None.

    That holds where ids rise with the merges and the tokenizer makes each token, given alone, one token: two neighbours whose
    bytes are a token then always are the pair that its merge names, since what lies between a token's ends merges as it would alone.
    """
    model, split, alphabet = described["model"], described["pre_tokenizer"] or {}, byte_alphabet()
    unusual = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    if model["type"] != "BPE" or any(model.get(k) for k in unusual) or described["normalizer"]:
        return None
    if split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    added = {t["content"] for t in described["added_tokens"]}
    ids = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [ids.get(t, -1) for t in merged]
    if len(ids) != 256 + len(merged) or not set(alphabet) <= set(ids) or any(x >= y for x, y in zip([-1, *order], order)):
        return None
    if any([t.id for t in tokenizer.model.tokenize(t)] != [i] for t, i in ids.items()):
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in ids.items()}


class Encoder:
    """Text to little-endian unsigned 32-bit ids, the end id included."""

    def __init__(self, path: str):
        self.path, self.end = path, np.array([END], dtype="<u4").tobytes()
        tokenizer = self._loaded()
        vocabulary = tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level token has a character for each.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        ranks = merge_ranks(tokenizer, described)
        self.single = self.runs = None
        if ranks:
            import tiktoken

            self.single, self.runs = (tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (SINGLE, PATTERN))
        self.added = "|".join(re.escape(t["content"]) for t in described["added_tokens"])

    def _loaded(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def tokenizer(self):
        """Kept only where texts need it: it takes more memory than everything else here."""
        return self._loaded()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list) -> list[bytes]:
        column = pa.array([t or "" for t in texts], pa.large_string())
        has = lambda pattern: pc.match_substring_regex(column, pattern).to_pylist()
        added = has(self.added) if self.added else [False] * len(texts)
        out = []
        for t, a, r in zip(texts, added, has(SPACE + "{2}"), strict=True):
            if a or self.single is None or r and LONG_RUN.search(t):
                ids = self._whole(t or "")
            else:
                ids = (self.runs if r else self.single)(t or "")
            out.append(np.array(array("I", ids), dtype="<u4").tobytes() + self.end)
        return out


def encoder(path: str) -> Encoder:
    known = process_cache()
    key = f"encoder {path}"
    if key not in known:
        known[key] = Encoder(path)
    return known[key]


class Statistics(NamedTuple):
    """Of the whole corpus: documents that hold each token id, documents, mean length."""

    df: np.ndarray
    docs: int
    mean: float


class Index:
    """BM25 over the token ids of a shard's documents, with the corpus' statistics."""

    def __init__(self, docs: list[np.ndarray], corpus: Statistics):
        self.n = len(docs)
        length = np.array([len(d) for d in docs])
        key = (np.repeat(np.arange(self.n, dtype=np.int64), length) << 32) | np.concatenate(docs).astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.concatenate([first, [len(key)]]))
        doc, term = key[first] >> 32, key[first] & 0xFFFFFFFF
        df = np.bincount(term)
        idf = np.log(1 + (corpus.docs - corpus.df + 0.5) / (corpus.df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / corpus.mean))
        self.terms = term
        self.rows = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = doc[order], impact[order].astype(np.float32).astype(np.float64)
        self.start, self.df = np.concatenate([[0], np.cumsum(df)]), df

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, for all terms of the seed but the end id."""
        terms = self.terms[self.rows[seed] : self.rows[seed + 1]]
        terms = terms[terms != END]
        n = self.df[terms]
        at = np.arange(n.sum()) + np.repeat(self.start[terms] - (np.cumsum(n) - n), n)
        return np.bincount(self.posting[at], weights=self.weight[at], minlength=self.n)

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that score above zero, by falling score."""
        score = self.scores(seed)
        score[used] = 0
        found = np.flatnonzero(score)
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], corpus: Statistics, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index, used = Index(docs, corpus), np.zeros(len(docs), dtype=bool)
    following, sequence, offset = 0, 0, 0
    seed, near = None, None

    def unused_in_order() -> int | None:
        nonlocal following
        while following < len(docs) and used[following]:
            following += 1
        return following if following < len(docs) else None

    current = unused_in_order()
    while current is not None:
        used[current] = True
        done, size = 0, len(docs[current])
        if offset == 0:
            seed, near = current, None
        while done < size:
            n = min(window - offset, size - done)
            yield current, done, n, sequence, offset
            done, offset = done + n, offset + n
            if offset == window:
                sequence, offset = sequence + 1, 0
                seed, near = current, None
        if near is None:
            near = index.neighbours(seed, used)
        current = next((d for d in near if not used[d]), None)
        if current is None:
            current = unused_in_order()


@lru_cache(maxsize=1)
def min_hashes(vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each min-hash: the ids in their random order, each id's place in it, and a random number an id."""
    rng, out = np.random.default_rng(17), []
    for _ in range(2):
        cost = rng.exponential(size=vocabulary) / (1 + np.arange(vocabulary))
        cost[END] = np.inf
        order = np.argsort(cost)
        rank = np.empty(vocabulary, dtype=np.int32)
        rank[order] = np.arange(vocabulary)
        out.append((order, rank, rng.integers(0, 1 << 40, vocabulary)))
    return out


def lexical_bins(tokens: list[bytes], vocabulary: int) -> np.ndarray:
    """A bin per document: two weighted min-hashes of its ids, later ids of the vocabulary (rarer pieces) weighing more.

    Two documents share a bin with about the square of their weighted similarity; bins are in random order.
    """
    flat, starts = np.frombuffer(b"".join(tokens), "<u4"), np.cumsum([0, *[len(t) // 4 for t in tokens]])[:-1]
    out = np.zeros(len(tokens), dtype=np.int64)
    for order, rank, drawn in min_hashes(vocabulary) if tokens else ():
        least = order[np.minimum.reduceat(rank[flat], starts)]
        out = out * 31 + drawn[least]
    return (out % BINS).astype(np.int32)


def encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Documents as ids, with their lexical bins; each task's last row has the document frequencies of what it encoded (bin -1), in ``df``."""
    encode = encoder(path)
    vocabulary = len(encode.width)
    df, docs, length = np.zeros(vocabulary, dtype="<i8"), 0, 0
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
        for a, b in slices(texts, PART):
            tokens = encode.encode(texts[a:b])
            flat, n = np.frombuffer(b"".join(tokens), "<u4"), np.array([len(t) // 4 for t in tokens])
            held = (np.repeat(np.arange(b - a, dtype=np.int64), n) << 32) | flat
            held.sort()
            df += np.bincount(held[np.concatenate([[True], held[1:] != held[:-1]])] & 0xFFFFFFFF, minlength=vocabulary)
            docs, length = docs + b - a, length + len(flat)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(tokens, pa.binary()), pa.array(lexical_bins(tokens, vocabulary)), pa.nulls(b - a, pa.binary())], names=["doc_id", "tokens", "bin", "df"])
    if docs:
        counts = np.concatenate([[docs, length], df]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([-1], pa.int32()), pa.array([counts], pa.binary())], names=["doc_id", "tokens", "bin", "df"])


def statistics(encoded: DataFrame) -> Statistics:
    """The tasks' counts added up; what comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for data in batch.column("df").to_pylist():
                n = np.frombuffer(data, "<i8")
                total = n.copy() if not len(total) else total + n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["id", "n"])

    sums = encoded.where("bin = -1").select("df").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(max((r["id"] for r in sums), default=1) + 1, dtype=np.int64)
    n[[r["id"] for r in sums]] = [r["n"] for r in sums]
    docs, length = int(n[0]), int(n[1])
    return Statistics(n[2:] if len(n) > 2 else np.zeros(1, np.int64), docs, length / max(1, docs))


def shards_of_bins(sizes: list[tuple[int, int]], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(bin, first shard, shards) from (bin, tokens): neighbouring bins share a shard until it is full, a larger bin is split over several."""
    out, shard, held = [], 0, 0
    for of, n in sorted(sizes):
        splits = -(-n // shard_tokens)
        if held and held + n > shard_tokens:
            shard, held = shard + 1, 0
        out.append((of, shard, max(1, splits)))
        if splits > 1:
            shard, held = shard + splits, 0
        else:
            held += n
    return out


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, shard_tokens: int = 400_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = stored(rows.mapInArrow(lambda batches: encode_rows(batches, path), TOKENS), "packing-tokens")
    corpus = statistics(encoded)
    body = encoded.where("bin >= 0").select("doc_id", "tokens", "bin")
    # at most BINS rows
    sizes = body.groupBy("bin").agg(F.sum(F.octet_length("tokens") / 4).cast("long").alias("n")).collect()
    plan = shards_of_bins([(r["bin"], r["n"]) for r in sizes], shard_tokens)
    shards = max((first + n for _, first, n in plan), default=1)
    of = F.broadcast(docs.sparkSession.createDataFrame(plan, "bin int, first long, splits long"))
    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "tokens"), F.col("splits"))
    dealt = body.join(of, "bin").select("doc_id", "tokens", shard.alias("shard")).repartition(-(-shards // SHARDS_A_TASK), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int | None, bytes]]] = {}
        for batch in batches:
            for i, t, s in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                held.setdefault(s, []).append((i, t))
        for s in sorted(held):
            rows = sorted(held.pop(s), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            docs, out = [np.frombuffer(t, dtype="<u4") for _, t in rows], []
            for d, start, n, sequence, offset in pack_shard(docs, corpus):
                i, t = rows[d]
                out.append((i, start, n, zlib.crc32(memoryview(t)[4 * start : 4 * (start + n)]), len(docs[d]), (s << 32) + sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)
