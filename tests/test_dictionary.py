"""Word segmentation and phrase conversion against plain loops, and automata for containment."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dictionary
from lodestone.operators import records, search
from lodestone.plans import catalog, catalog_text, registry  # noqa: F401

DIR = "/root/testdata/sf0.001"


def ways(run, words):
    """Every way to cut a run into dictionary words and single characters."""
    if not run:
        yield []
        return
    for n in range(1, len(run) + 1):
        if n == 1 or run[:n] in words:
            for rest in ways(run[n:], words):
                yield [run[:n], *rest]


def test_best_path_against_all_ways():
    import math

    rng = random.Random(3)
    for _ in range(300):
        words = {"".join(rng.choices("abc", k=rng.randrange(1, 4))): float(rng.randrange(1, 9)) for _ in range(rng.randrange(0, 7))}
        total = sum(words.values()) + 1
        lexicon = dictionary.Lexicon(words)
        run = "".join(rng.choices("abcd", k=rng.randrange(1, 9)))

        def rank(way, words=words, total=total):
            cost = 0.0
            for w in reversed(way):
                cost = round(cost - math.log(words[w] / total), 9) if w in words else cost - math.log(0.5 / total)
            return sum(w not in words for w in way), len(way), round(cost, 6), [-len(w) for w in way]

        assert dictionary.best_path(lexicon, run, total) == min(ways(run, words), key=rank)
        everything = dictionary.all_words(lexicon, run)
        inside = [run[i:j] for i in range(len(run)) for j in range(len(run), i, -1) if run[i:j] in words]
        alone = [c for i, c in enumerate(run) if not any(run[a:b] in words for a in range(i + 1) for b in range(i + 1, len(run) + 1))]
        assert sorted(everything) == sorted(inside + alone)


def test_overlapping_words(spark):
    words = spark.createDataFrame([("南京", 9), ("南京市", 5), ("市长", 5), ("长江", 7), ("大桥", 6), ("长江大桥", 4), ("江大桥", 1), ("f16", 3)], "word string, n long")
    df = spark.createDataFrame([("南京市长江大桥 F-16x", ), (None,), ("",), ("桥abc",)], "t string")
    index, ask = dictionary.segmenter(words, "index"), dictionary.segmenter(words, "search")
    got = df.select(index(F.col("t")).alias("i"), ask(F.col("t")).alias("s")).collect()
    assert got[0]["i"] == ["南京市", "南京", "市长", "长江大桥", "长江", "江大桥", "大桥", "f", "16x"] and got[0]["s"] == ["南京市", "长江大桥", "f", "16x"]
    assert got[1]["i"] == got[1]["s"] == got[2]["s"] == [] and got[3]["s"] == ["桥", "abc"]
    with pytest.raises(ValueError):
        dictionary.segmenter(words, "index", max_words=3)
    with pytest.raises(ValueError):
        dictionary.segmenter(words, "both")
    nothing = dictionary.segmenter(words.limit(0), "search")
    assert df.select(nothing(F.col("t")).alias("s")).first()["s"][:3] == ["南", "京", "市"]


def test_segmentation_of_whole_documents(spark):
    got = {r["doc_id"]: r for r in registry.queries()["word_segmentation"](spark, DIR).collect()}
    docs, _, words = catalog_text._spaceless(spark, DIR)
    known = {r["word"]: float(r["n"]) for r in words.collect()}
    longest, total = max(map(len, known)), sum(known.values()) + 1
    lexicon = dictionary.Lexicon(known)
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        if len(text) > 4000:
            continue
        every, best, at = [], [], 0
        for run in [*re.finditer(catalog_text.LETTERS, text), None]:
            between = re.findall(r"[^\W_]+", text[at:run.start() if run else len(text)])
            every += between
            best += between
            if run:
                at, x = run.end(), run.group()
                reach = 0
                for i in range(len(x)):
                    here = [x[i:j] for j in range(min(len(x), i + longest), i, -1) if x[i:j] in known]
                    every += here or ([x[i]] if i >= reach else [])
                    reach = max([reach, *(i + len(w) for w in here)])
                best += dictionary.best_path(lexicon, x, total)
        digest = lambda ws: hashlib.md5(" ".join(ws).encode()).hexdigest()
        assert (got[r["doc_id"]]["index_words"], got[r["doc_id"]]["index_md5"]) == (len(every), digest(every))
        assert (got[r["doc_id"]]["search_words"], got[r["doc_id"]]["search_md5"]) == (len(best), digest(best))


def test_search_with_two_sides(spark):
    docs, items, words = catalog_text._spaceless(spark, DIR)
    both = {side: dictionary.segmenter(words, side, script=catalog_text.LETTERS) for side in ("index", "search")}
    full = search.bm25(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"), analyzer=both["index"], search_analyzer=both["search"])
    want = search.top_k(full.withColumn("score", F.round("score", 9)), "query_id", "score", "id", 10)
    got = registry.queries()["bm25_segmented"](spark, DIR)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(got) == key(want) and got.count() > 50


def plain_convert(text, table):
    out, i = "", 0
    while i < len(text):
        fits = [s for s in table if s and text.startswith(s, i)]
        if fits:
            best = max(fits, key=len)
            out, i = out + (table[best] or ""), i + len(best)
        else:
            out, i = out + text[i], i + 1
    return out


def test_conversion_by_longest_match(spark):
    # phrase and character rules disagree: the character alone would become another one
    table = {"髮": "发", "發": "发", "乾": "干", "乾坤": "乾坤", "皇后": "皇后", "後": "后", "頭髮": "头发", "乾隆": "乾隆", "": "x", "刪": None}
    rows = spark.createDataFrame(list(table.items()), "source string, target string")
    texts = ["乾坤乾淨", "皇后後來", "頭髮發", "", None, "刪a刪", "乾"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(dictionary.converter(rows)(F.col("t"))).collect()]
    assert got == ["乾坤干淨", "皇后后來", "头发发", "", None, "a", "干"]
    rng = random.Random(5)
    for _ in range(300):
        small = {"".join(rng.choices("ab", k=rng.randrange(1, 4))): rng.choice(["X", "", "yy"]) for _ in range(4)}
        text = "".join(rng.choices("abc", k=rng.randrange(0, 20)))
        assert dictionary.convert(dictionary.Lexicon(small), text) == plain_convert(text, small)


def test_registered_conversion(spark):
    got = {r["doc_id"]: r["converted_md5"] for r in registry.queries()["phrase_conversion"](spark, DIR).collect()}
    table = {"e": "3", "th": "þ", " ": "_"}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        words = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        table.update({f"{a} {b}": f"{a} {b}".upper() for a, b in zip(words, words[1:], strict=False)})
    by_first = {}
    for s in table:
        by_first.setdefault(s[0], []).append(s)
    checked = 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        text = r["text"] or ""
        if len(text) < 1500:
            out, i = "", 0
            while i < len(text):
                fits = [s for s in by_first.get(text[i], []) if text.startswith(s, i)]
                best = max(fits, key=len, default=None)
                out, i = out + (text[i] if best is None else table[best]), i + len(best or "x")
            assert got[r["doc_id"]] == hashlib.md5(out.encode()).hexdigest()
            checked += 1
    assert checked > 50


def test_containment_in_long_strings_by_several_automata(spark):
    rng = random.Random(6)
    short = ["".join(rng.choices("ab", k=rng.randrange(1, 12))) for _ in range(120)] + ["", None, "x" * 10_000]
    long = ["".join(rng.choices("ab", k=rng.randrange(0, 40))) for _ in range(80)] + ["".join(rng.choices("abc", k=10_000)), "x" * 10_001, None, ""]
    a, b = spark.createDataFrame([(x,) for x in short], "s string"), spark.createDataFrame([(x,) for x in long], "t string")
    for threshold in (0.0, 0.4):
        want = {(x, y) for x in short for y in long if x and y and x in y and len(x) >= threshold * len(y)}
        for options in ({}, {"patterns": 7, "broadcast_bytes": 0}):
            got = records.contained_pairs(a, b, "s", "t", threshold, **options).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want


def reference_tokenizer(pieces):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *pieces]))}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


def test_pieces_are_the_librarys(spark):
    rng = random.Random(9)
    pieces = sorted({rng.choice(["", "##"]) + "".join(rng.choices("abcF1中", k=rng.randrange(1, 4))) for _ in range(90)} | {"-", "。", "##"})
    texts = ["".join(rng.choices("aabbcF1 \t-。中文$€\x00\u200d", k=rng.randrange(0, 40))) for _ in range(300)] + ["a" * 100, "a" * 101, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    split = dictionary.wordpieces(spark.createDataFrame([(p,) for p in pieces], "piece string"))
    got = [r[0] for r in df.select(split(F.col("t"))).collect()]
    plain = reference_tokenizer([p for p in pieces if p != "##"])
    for t, g in zip(texts, got, strict=True):
        assert g == (plain.encode(t, add_special_tokens=False).tokens if t else []), repr(t)


def test_entities_of_subwords_against_plain_loops(spark):
    import json

    from tests.test_golden import plain_alignment

    got = {r["doc_id"]: r for r in registry.queries()["subword_entities"](spark, DIR).collect()}
    pieces = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        for w in re.findall(r"[^\W_]+", r["text"] or ""):
            pieces |= {w, *w}
    plain = reference_tokenizer(sorted(pieces | {f"##{p}" for p in pieces}))
    checked = 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        text = r["text"] or ""
        if not text or len(text) > 3000:
            continue
        tokens = plain.encode(text, add_special_tokens=False).tokens
        tags = ["O" if i is None or i % 7 == 6 else "B-A" if i % 7 == 0 else "I-A" for i in plain_alignment(text, tokens, len(text))]
        found, start = [], None
        for i, t in enumerate([*tags, "O"]):
            if start is not None and t != "I-A":
                if sum(len(x.replace("##", "")) for x in tokens[start:i]) >= 2:
                    found.append({"start": start, "length": i - start, "type": "A"})
                start = None
            if t == "B-A":
                start = i
        mine = got[r["doc_id"]]
        digest = lambda s: hashlib.md5(s.encode()).hexdigest()
        assert (mine["pieces"], mine["pieces_md5"]) == (len(tokens), digest(" ".join(tokens)))
        assert (mine["entities"], mine["entities_md5"]) == (len(found), digest(json.dumps(found, separators=(",", ":"))))
        checked += 1
    assert checked > 100


def test_texts_become_words_in_small_parts(spark):
    """A batch is handed on in parts, so a task holds the words of a few texts, not of ten thousand."""
    import pyarrow as pa

    from lodestone.functions import html
    from lodestone.functions.parts import small_parts
    from lodestone.operators import annotation

    texts = pa.array(["the cat " * 5_000, None, "", "cat"] * 40)
    assert pa.concat_arrays([t for (t,) in small_parts([texts])]).equals(texts) and len(small_parts([texts.slice(0, 0)]).__next__()[0]) == 0
    parts = [*html.visible_text.func(iter([texts]))]
    assert len(parts) > 5 and sum(map(len, parts)) == len(texts)
    tokens, tags = pa.array([["the", "cat"], None, [], ["cat"]] * 40), pa.array([["A", "B", "C", "D", None, "F"], [], ["X"], ["Y"]] * 40)
    parts = [*annotation._token_tags.func(iter([(texts, tokens, tags)]))]
    assert len(parts) > 5 and pa.concat_arrays(parts).to_pylist() == [["A", None], None, [], ["Y"]] * 40
    split = dictionary.segmenter(spark.createDataFrame([("the", 2), ("cat", 1)], "word string, n long"), "index", script="[a-z]+")
    rows = spark.range(4000).select("id", split(F.concat(F.lit("thecat"), F.repeat(F.lit("cat"), (F.col("id") % 700).cast("int")))).alias("w"))
    assert rows.where(F.size("w") != 2 + F.col("id") % 700).isEmpty()


def test_a_token_is_not_looked_for_in_the_whole_text():
    from lodestone.operators import annotation

    class Text(str):
        longest = 0

        def find(self, piece, start=0, end=None):
            Text.longest = max(Text.longest, (len(self) if end is None else min(end, len(self))) - start)
            return super().find(piece, start, len(self) if end is None else end)

    text = Text("a b " * 2000)
    assert annotation.align_tokens(text, ["zz", "a", "zz", "b"] * 500, len(text))[1] is not None and Text.longest < 100


class CountedLexicon(dictionary.Lexicon):
    tries = 0

    def at(self, text, start):
        self.tries += 1
        return super().at(text, start)


def test_a_text_is_not_tried_place_by_place(monkeypatch):
    words = {"ab": 1.0, "abc": 2.0, "bc": 3.0, "c": 1.0}
    lexicon = CountedLexicon(words)
    text = "abcab" * 2000
    # pieces of a text end within words
    monkeypatch.setattr(dictionary, "STEP", 7, raising=False)
    assert dictionary.all_words(lexicon, text) == ["abc", "ab", "bc", "c", "ab"] * 2000
    assert dictionary.best_path(lexicon, text, 8.0) == ["abc", "ab"] * 2000
    assert dictionary.convert(CountedLexicon({"ab": "1", "abc": "2", "b": "3"}), text) == "21" * 2000
    assert lexicon.tries <= len(words)


def test_large_sides_of_a_match_are_not_broadcast(spark):
    """Sizes that Spark guesses from compressed files are too small; 20,001 queries and all entities are shuffled."""
    from lodestone.operators import resolve

    queries = spark.range(20_001).select(F.col("id").alias("q"), F.when(F.col("id") < 3, F.concat(F.lit("name "), F.col("id").cast("string"))).otherwise("--").alias("query"), F.lit("").alias("link"))
    entities = spark.range(5).select(
        F.col("id").alias("ord"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("label"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("link"), F.array().cast("array<string>").alias("aliases_zh"),
        F.array().cast("array<string>").alias("aliases_en"))
    found = resolve.candidates(queries, entities)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["q"], r["ord"], r["tier"]) for r in found.collect()) == [(i, i, 1) for i in range(3)]


def test_scores_are_rounded_once_for_all_queries_of_a_class(spark):
    for name in ("bm25_bool_should", "bm25_multi_match_best_fields", "bm25_best_fields_with_content"):
        plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join Inner") < plan.index("round("), name


def test_full_scores_reach_null_and_repeated_queries(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string")
    asked = spark.createDataFrame([(7, "a"), (None, "a"), (8, "a"), (9, "c b")], "q long, t string")
    want = sorted([(7, 1), (-1, 1), (8, 1), (9, 1), (9, 2)])
    for rows in (1_000_000, 0):
        hits = search.bm25(docs, "id", F.col("t"), asked, "q", F.col("t"), broadcast_rows=rows)
        assert sorted((-1 if r["query_id"] is None else r["query_id"], r["id"]) for r in hits.collect()) == want
