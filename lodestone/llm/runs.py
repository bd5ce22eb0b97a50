"""Periodic run detection: the maximal repetitions of a sequence of words, by the algorithm of Kolpakov and Kucherov.

A sequence is cut into its LZ factors with a suffix automaton (each factor is the longest stretch that began earlier, or a new word).
A repetition that touches the border of two factors is found there by Main's algorithm, from longest common extensions
on both sides (Z function), in time linear in the two factors. Every other repetition lies inside a factor and is
copied from the factor's earlier occurrence. Linear time over all, whatever the words are.

In a run of at least ``min_length`` words and ``min_exponent`` periods every short stretch of words occurs twice (``gram`` says how
short it has to be), so only maximal areas covered by stretches that repeat within the document can hold one. These areas are
found for a batch of documents at once from hashes; a collision only adds an area. The algorithm runs on each area whole: no run is lost, and a document that
is periodic throughout is one area.

Documents are independent: nothing is shuffled or gathered, and a lost executor's documents are read again. Memory is that of a batch's words, in slices of about two
million characters, and of one area's automaton.

Defined results: null text has no words; a text without runs has an empty array and collapses to its words joined by one space.
Repeated rows are judged each. Extra columns stay. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, slices

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
FOUND = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])


def automaton(x: Sequence[int]) -> tuple[list[dict], list[int]]:
    """Suffix automaton: transitions, and where each state's words end first."""
    go: list[dict] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for end, c in enumerate(x):
        state = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(end)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                link[q] = link[state] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = state
    return go, first


def factors(x: Sequence[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, end, start of an earlier occurrence or -1)."""
    go, first = automaton(x)
    out, start, n = [], 0, len(x)
    while start < n:
        state, end = 0, start
        while end < n:
            to = go[state][x[end]]
            if first[to] >= end:
                break
            state, end = to, end + 1
        if end == start:
            out.append((start, start + 1, -1))
            start += 1
        else:
            out.append((start, end, first[state] - (end - start) + 1))
            start = end
    return out


def z_function(s: Sequence[int]) -> list[int]:
    """Length of the common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def border_runs(x: Sequence[int], low: int, border: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Main: repetitions (start, end, period) that touch ``border``, as far as they reach in [low, high)."""
    u, v = list(x[low:border]), list(x[border:high])
    back = u[::-1]
    # a whole period lies behind the border
    if v:
        ahead, behind = z_function(v), z_function([*back, -1, *v[::-1], *back])
        shift = len(u) + 1 + len(v)
        for p in range(1, len(v) + 1):
            suffix, prefix = behind[shift - p], ahead[p] if p < len(v) else 0
            if suffix + prefix >= p:
                yield border - suffix, border + p + prefix, p
    # a whole period lies before the border
    if u:
        behind, ahead = z_function(back), z_function([*v, -1, *u, *v])
        shift = len(v) + 1 + len(u)
        for p in range(1, len(u) + 1):
            suffix, prefix = behind[p] if p < len(u) else 0, ahead[shift - p]
            # what the window behind the border shows of itself is no repetition with what lies before it
            prefix = min(prefix, len(v))
            if suffix + prefix >= p:
                yield border - p - suffix, border + prefix, p


def runs(x: Sequence[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All maximal repetitions (start, end, smallest period) of at least ``min_length`` words and ``min_exponent`` (two or more) periods."""
    n = len(x)
    at: dict[int, dict[int, int]] = {}

    def add(start: int, end: int, period: int) -> None:
        if end - start < max(min_length, min_exponent * period):
            return
        if start and x[start - 1] == x[start - 1 + period] or end < n and x[end] == x[end - period]:
            return
        ends = at.setdefault(start, {})
        ends[end] = min(period, ends.get(end, period))

    before = 0
    for start, end, earlier in [*factors(x), (n, n, -1)]:
        if start:
            low = max(0, start - 2 * (start - before) - (end - start) - 1)
            for found in border_runs(x, low, start, end):
                add(*found)
        if earlier >= 0:
            shift = start - earlier
            for s in range(earlier + 1, end - shift):
                for e, p in [*at.get(s, {}).items()]:
                    if e + shift < end:
                        at.setdefault(s + shift, {})[e + shift] = p
        before = start
    return sorted((s, e, p) for s, ends in at.items() for e, p in ends.items())


def gram(min_length: int, min_exponent: int) -> int:
    """Stretches of so many words occur twice in every run: a shift by the period to one side or the other stays within it."""
    return max(1, int(min_length * (min_exponent - 2) / min_exponent))


def areas(words: list[list[bytes]], min_length: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) of the maximal areas covered by stretches of ``size`` words that repeat in their document."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    if not n:
        return
    h = np.fromiter(map(hash, chain.from_iterable(words)), dtype=np.int64, count=n).view(np.uint64)
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(starts + lengths, lengths)
    key = np.zeros(n, dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for k in range(min(size, n)):
        key *= odd
        key[:n - k] += h[k:]
        key ^= key >> np.uint64(29)
    key = (key + doc.astype(np.uint64)) * odd
    whole = np.flatnonzero(np.arange(n) + size <= ends)
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    covered[at] += 1
    np.add.at(covered, at + size, -1)
    inside = np.concatenate([np.cumsum(covered[:n]) > 0, [False]])
    opens = np.concatenate([[True], ~inside[:n - 1] | (doc[1:] != doc[:-1])]) & inside[:n]
    closes = inside[:n] & np.concatenate([~inside[1:n] | (doc[1:] != doc[:-1]), [True]])
    for a, b in zip(np.flatnonzero(opens).tolist(), (np.flatnonzero(closes) + 1).tolist(), strict=True):
        if b - a >= min_length:
            d = int(doc[a])
            yield d, a - int(starts[d]), b - int(starts[d])


def found_in(texts: list, min_length: int, min_exponent: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text."""
    words = [t.encode().split() if t else [] for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, a, b in areas(words, min_length, gram(min_length, min_exponent)):
        ids: dict[bytes, int] = {}
        x = [ids.setdefault(w, len(ids)) for w in words[d][a:b]]
        found[d] += [(a + s, a + e, p) for s, e, p in runs(x, min_length, min_exponent)]
    for d, rs in enumerate(found):
        if rs:
            rs.sort()
            drop = np.zeros(len(words[d]) + 1, dtype=np.int64)
            for s, e, p in rs:
                drop[s + p] += 1
                drop[e] -= 1
            words[d] = [w for w, k in zip(words[d], np.cumsum(drop).tolist(), strict=False) if not k]
    return [[{"start": s, "length": e - s, "period": p} for s, e, p in rs] for rs in found], [b" ".join(w) for w in words]


def finder(at: int, min_length: int, min_exponent: int, keep_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                rs, left = found_in(texts[a:b], min_length, min_exponent)
                new = pa.StructArray.from_arrays([pa.array(rs, kind), pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])
                columns = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, new], [str(i) for i in range(len(columns) + 1)])

    return find


def find_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, into: str = "periodic", keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` if it is not to be kept) and a new last column: struct of ``runs`` (start, length, period; words from 0, by
    start and period) and ``collapsed`` text.

    Collapsing drops the words that any run holds after its first period.
    """
    name, = fresh(docs, into)
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    numbered = docs.toDF(*[str(i) for i in range(len(docs.columns))])
    schema = StructType([*[StructField(str(i), f.dataType) for i, f in enumerate(kept)], StructField(str(len(kept)), FOUND)])
    return numbered.mapInArrow(finder(docs.columns.index("text"), min_length, min_exponent, keep_text), schema).toDF(*[f.name for f in kept], name)


def longest_exponent(found: Column) -> Column:
    """The run of greatest length / period, compared as whole numbers; ties to the smallest start, then period; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(found, order), F.lit(0))
