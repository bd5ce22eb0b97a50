"""The pipeline and each of its stages against brute force on a small table."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_groups(docs):
    sets, root = {i: shingles(t) for i, t, *_ in docs}, {i: i for i, *_ in docs}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def sampled(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(d) for d in docs])
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.ORACLE}) WHERE sampled").fetchall()}


def expected(rows):
    """Per stage but the last, the rows that are left."""
    lang = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    # of exact copies the longest stays, then the smallest id
    for r in sorted(lang, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(re.sub(r"\s", "", r[1]), r)
    exact = sorted(first.values(), key=lambda r: r[0])
    root = near_groups(exact)
    near = [r for r in exact if root[r[0]] == r[0]]
    kept = sampled(near)
    return [lang, exact, near, [r for r in near if r[0] in kept]]


def documents(labelled):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "tu", "se") for b in ("lan", "der", "pos", "nim", "gol", "vet")]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randrange(30, 90)))
        rows.append((i, text, ("en" if i % 2 else "de") if labelled else None, f"s{i % 3}", len(text)))
    for i in range(0, 24, 3):
        w = rows[i][1].split()
        rows.append((100 + i, "  ".join(w), *rows[i][2:]))
        rows.append((200 + i, " ".join([*w, "ending"]), *rows[i][2:]))
    return [*rows, (300, None, None, "s1", None), (301, "", None, "s1", 0), (302, "12 !!", None, None, 5)]


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_and_run_against_brute_force(spark, tmp_path, labelled):
    rows = documents(labelled)
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = expected(rows)
    assert len(left[0]) > len(left[1]) > len(left[2]) > len(left[3]) > 0
    for (_, stage), want in zip(corpus_pipeline.STAGES, left, strict=False):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
        docs = spark.createDataFrame(want, DOCS)
    tokens = packing.encoder(packing.default_tokenizer()).encode([r[1] for r in left[3]])
    want = {r[0]: len(np.frombuffer(t, "<u4")) for r, t in zip(left[3], tokens, strict=True)}
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got = {}
        for r in pieces.collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert got == want


def test_run_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, an extra column, and nothing at all."""
    text = "ein langer satz mit genau so vielen worten wie es braucht"
    rows = [(None, text + " eins", "de", None, None), (1, text, "de", "s", 3), (1, text, "de", "s", 3), (1, "the other text of one id", "en", None, 1), (2, "the third text is not like any of them", None, "s", 2), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS token", "2 AS gone")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r["doc_id"] for r in got} <= {None, 1, 2} and got
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path / "a"))
        assert current.columns == docs.columns
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
