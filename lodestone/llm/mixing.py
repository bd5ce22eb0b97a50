"""Mixing sources to target weights by iterative proportional fitting.

Token counts per cell (source, language, topic) are raked to the target shares of the three
marginals; the raked share of a cell, the token budget and the cell's tokens give the probability
with which each of its documents is kept. Probabilities above one are cut, and the common factor
is solved again so that the expected tokens still meet the budget. Documents draw their uniform
number from a digest of their id, so the sample is the same however the rows are dealt.

Everything is DataFrame and SQL expressions: the cells are one aggregate (partial sums before the
shuffle). Where a round of raking takes at most ``max_steps`` steps (cells times values) it is a fold over the
cells' weights in one row; with more, the same rounds are one aggregate and join per axis over the table of
cells. Either way every source and language has its own target and the results are the same.

Defined results: null source or language is the category ``(none)``; null text has no tokens and
topic ``prose``; a document without tokens is kept with its cell's probability; a source, language or topic
without any tokens, or whose target is zero, has share and probability 0; an empty table gives an empty
table. Rows that repeat an id are all kept or all dropped. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

AXES = ("source", "lang", "topic")
ROUNDS = 40


def default_topic(text: Column) -> Column:
    return (
        F.when(text.contains(" | "), "tabular").when(text.rlike("(?i)licen[cs]e"), "legal")
        .when(text.rlike(r"@|\+\d"), "contact").otherwise("prose"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """52 bits of a digest as a number in [0, 1)."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _rake(w: str, axis: str) -> str:
    """Weights scaled so that the sums along ``axis`` meet its targets."""
    sums = f"transform({axis}_target, (t, k) -> aggregate(sequence(0, size(cells) - 1), 0D, (a, j) -> a + if({axis}_of[j] = k, {w}[j], 0D)))"
    # a value whose weights are all zero (no tokens, or another axis' target is zero) has no share to scale
    return f"transform(array({sums}), s -> transform({w}, (x, j) -> if(s[{axis}_of[j]] > 0, x * {axis}_target[{axis}_of[j]] / s[{axis}_of[j]], 0D)))[0]"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def raked_cells(cells: DataFrame, *, fraction: float, temper: float, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(source, lang, topic, tokens, share, probability) from (source, lang, topic, tokens)."""
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*AXES, "tokens"))).alias("cells"))
    for axis in AXES:
        one = one.withColumn(f"{axis}_values", F.array_sort(F.array_distinct(F.col(f"cells.{axis}"))))
        one = one.withColumn(f"{axis}_of", F.expr(f"transform(cells, c -> cast(array_position({axis}_values, c.{axis}) AS int) - 1)"))
        if axis in targets:
            given = F.create_map(*[F.lit(x) for kv in targets[axis].items() for x in (kv[0], float(kv[1]))])
            one = one.withColumn("given", given)
            raw = F.expr(f"transform({axis}_values, v -> coalesce(try_element_at(given, v), 0D))")
        else:
            raw = F.expr(f"transform({axis}_values, v -> power(aggregate(cells, 0D, (a, c) -> a + if(c.{axis} = v, c.tokens, 0)), {temper}D))")
        one = one.withColumn("raw", raw)
        one = one.withColumn(f"{axis}_target", F.expr("transform(raw, x -> coalesce(try_divide(x, aggregate(raw, 0D, (a, y) -> a + y)), 0D))")).drop("raw", "given")
    one = cut(one)
    step = _let("w1", _rake("w", "source"), _let("w2", _rake("w1", "lang"), _rake("w2", "topic")))
    start = "transform(cells, c -> greatest(c.tokens, 1) / aggregate(cells, 0D, (a, d) -> a + greatest(d.tokens, 1)))"
    one = one.withColumn("start", F.expr(start))
    one = cut(one.withColumn("share", F.expr(f"aggregate(sequence(1, {ROUNDS}), start, (w, r) -> {step})")))
    one = one.withColumn("budget", F.expr(f"{fraction}D * aggregate(cells, 0D, (a, c) -> a + c.tokens)"))
    over = "f * budget * share[j] >= cells[j].tokens"
    fill = (
        "aggregate(sequence(1, 30), 1D, (f, r) -> "
        f"coalesce((budget - aggregate(sequence(0, size(cells) - 1), 0D, (a, j) -> a + if({over}, cells[j].tokens, 0D)))"
        f" / nullif(budget * aggregate(sequence(0, size(cells) - 1), 0D, (a, j) -> a + if({over}, 0D, share[j])), 0D), f))")
    one = one.withColumn("factor", F.expr(fill)).where("size(cells) > 0")
    cell = one.select("budget", "factor", F.explode(F.arrays_zip("cells", "share")).alias("z"))
    return cell.select(
        *[F.col(f"z.cells.{a}").alias(a) for a in AXES], F.col("z.cells.tokens").alias("tokens"), F.col("z.share").alias("share"),
        F.least(F.lit(1.0), F.col("factor") * F.col("budget") * F.col("z.share") / F.greatest(F.col("z.cells.tokens"), F.lit(1))).alias("probability"))


def raked_table(cells: DataFrame, *, fraction: float, temper: float, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """As ``raked_cells``, by aggregates and joins: no row holds more than one cell."""
    total = cells.agg(F.sum("tokens").cast("double").alias("n"), F.sum(F.greatest("tokens", F.lit(1))).cast("double").alias("w")).first()
    w = cells.withColumn("share", F.greatest("tokens", F.lit(1)) / F.lit(total["w"]))
    for axis in AXES:
        raw = cells.groupBy(axis).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(temper))).alias("raw"))
        if axis in targets:
            given = cells.sparkSession.createDataFrame([(v, float(t)) for v, t in targets[axis].items()], f"{axis} string, given double")
            raw = raw.join(given, axis, "left").select(axis, F.coalesce("given", F.lit(0.0)).alias("raw"))
        raw = cut(raw)
        whole = raw.agg(F.sum("raw")).first()[0]
        w = w.join(raw.select(axis, (F.col("raw") / F.lit(whole or 1.0)).alias(f"{axis}_target")), axis)
    w = cut(w)
    for _ in range(ROUNDS):
        for axis in AXES:
            w = w.join(w.groupBy(axis).agg(F.sum("share").alias("s")), axis)
            w = w.withColumn("share", F.when(F.col("s") > 0, F.col("share") * F.col(f"{axis}_target") / F.col("s")).otherwise(0.0)).drop("s")
            w = cut(w)
    budget, factor = fraction * total["n"], 1.0
    for _ in range(30):
        over = F.lit(factor * budget) * F.col("share") >= F.col("tokens")
        got = w.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("share"))).alias("open")).first()
        if not budget * got["open"]:
            break
        before, factor = factor, (budget - got["full"]) / (budget * got["open"])
        if factor == before:
            break
    probability = F.least(F.lit(1.0), F.lit(factor * budget) * F.col("share") / F.greatest("tokens", F.lit(1)))
    return w.select(*AXES, "tokens", "share", probability.alias("probability"))


def sample_mixture(
    docs: DataFrame,
    *,
    fraction: float = 0.5,
    temper: float = 0.5,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    topic: Column | None = None,
    seed: int = 7,
    max_steps: int = 20_000,
) -> DataFrame:
    """``docs`` and the columns topic, tokens, share, probability, sampled in one struct ``mix``.

    targets: per axis the wanted token shares; an axis without any gets shares in proportion to
    its tokens to the power ``temper``. fraction: of all tokens, expected in the sample.
    max_steps: cells times values of the largest axis up to which one row holds all cells.
    """
    mix, s, l, t, n = fresh(docs, "mix", "s", "l", "t", "n")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = docs.withColumns({
        s: none("source"), l: none("lang"), t: F.coalesce(topic if topic is not None else default_topic(F.col("text")), F.lit("prose")),
        n: token_count(F.col("text"))})
    cells = cut(rows.groupBy(F.col(s).alias("source"), F.col(l).alias("lang"), F.col(t).alias("topic")).agg(F.sum(n).alias("tokens")))

    values = cells.agg(F.count_distinct("source").alias("s"), F.count_distinct("lang").alias("l"), F.count(F.lit(1)).alias("n")).first()
    few = max(values["s"], values["l"]) * values["n"] <= max_steps
    final = (raked_cells if few else raked_table)(cells, fraction=fraction, temper=temper, targets=targets or {})
    final = final.select(
        F.col("source").alias("c_source"), F.col("lang").alias("c_lang"), F.col("topic").alias("c_topic"), "share", "probability")
    if few:
        # at most max_steps rows
        final = F.broadcast(final)
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), s, l, t, n)
    out = out.join(final, (F.col(s) == F.col("c_source")) & (F.col(l) == F.col("c_lang")) & (F.col(t) == F.col("c_topic")))
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.struct(
            F.col(t).alias("topic"), F.col(n).alias("tokens"), "share", "probability",
            (uniform(F.col("row.doc_id"), seed) < F.col("probability")).alias("sampled")).alias(mix))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         coalesce(CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'legal'
              WHEN regexp_matches(text, '@|\+\d') THEN 'contact' ELSE 'prose' END, 'prose') AS topic,
         coalesce(len(regexp_extract_all(text, '\S+')), 0) AS tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
ts AS (SELECT source, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t FROM c GROUP BY source),
tl AS (SELECT lang, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t FROM c GROUP BY lang),
tt AS (SELECT topic, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t FROM c GROUP BY topic),
base AS (SELECT c.source, c.lang, c.topic, c.tokens, ts.t AS a, tl.t AS b, tt.t AS e, c.tokens / sum(c.tokens) OVER () AS w
         FROM c JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic)),
ipf AS (
  SELECT 0 AS i, * FROM base
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, a, b, e, w * e / sum(w) OVER (PARTITION BY topic) AS w
  FROM (SELECT i, source, lang, topic, tokens, a, b, e, w * b / sum(w) OVER (PARTITION BY lang) AS w
        FROM (SELECT i, source, lang, topic, tokens, a, b, e, w * a / sum(w) OVER (PARTITION BY source) AS w
              FROM ipf WHERE i < {ROUNDS}) x) y),
raked AS (SELECT source, lang, topic, tokens, w, 0.5 * sum(tokens) OVER () AS budget FROM ipf WHERE i = {ROUNDS}),
fac AS (
  SELECT 0 AS r, 1::DOUBLE AS f
  UNION ALL
  SELECT r + 1, coalesce((SELECT (max(budget) - sum(CASE WHEN f * budget * w >= tokens THEN tokens ELSE 0 END))
                / nullif(max(budget) * sum(CASE WHEN f * budget * w >= tokens THEN 0 ELSE w END), 0) FROM raked), f)
  FROM fac WHERE r < 30),
p AS (SELECT source, lang, topic, w, least(1, f * budget * w / greatest(tokens, 1)) AS probability
      FROM raked, (SELECT f FROM fac WHERE r = 30))
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(w, 6) AS share, round(probability, 6) AS probability,
       ('0x' || substr(md5(doc_id || '|7'), 1, 13))::BIGINT / 4503599627370496.0 < probability AS sampled
FROM d JOIN p USING (source, lang, topic)
"""
