"""Toxicity: length-normalised log-likelihoods under class-conditional Kneser-Ney models.

Toxic and ordinary text are modelled together (see ``kneser_ney``, contrast): rare words and bigrams lean on the common
back-off counts. A document's evidence is the difference of its two log-likelihoods, less what a middling labelled document has per
token, over its length and PAD neutral tokens more, so that a few words can't weigh like a whole text. An isotonic curve, fitted on labelled rows that
the counts have not seen, turns evidence into the share of toxic rows at it; it is fitted on a histogram of
evidence (BIN wide, bounded to +-LIMIT), so the driver sees a bounded number of rows. (A logistic curve fits badly: many toxic texts have no evidence at all.)

Defined results: a null or empty text is the boundary alone and gets that evidence's probability;
without both classes among the labelled rows every score is 0. Documents with equal evidence have equal scores; rows that
repeat an id share one score. Texts of any length count in whole. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import cut

BIN, LIMIT, PAD, TRACE = 0.0005, 10.0, 30, 0.01


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best rising step function through weighted rows (pooling neighbours that fall)."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i] * n[i], y[i] * n[i], n[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def score(docs: DataFrame, counted: Column, calibrating: Column, toxic: Column, *, prior: float = 20.0, pair_prior: float = 1000.0) -> DataFrame:
    """(doc_id, score) per row of ``docs``; ``counted`` rows give the counts, ``calibrating`` ones the curve."""
    model = kneser_ney.train(docs, [counted & (toxic == 1), counted & (toxic == 0)], contrast=True, prior=prior, pair_prior=pair_prior)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    scored = kneser_ney.score(docs, model)
    rows = docs.select("doc_id", F.when(calibrating, toxic).alias("label"))
    rows = cut(rows.join(scored, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select("doc_id", "label", "total", "words"))
    middle = rows.where("label IS NOT NULL").agg(F.percentile_approx(F.col("total") / F.col("words"), 0.5, 100_000)).first()[0] or 0.0
    rows = rows.select("doc_id", "label", ((F.col("total") - F.lit(middle) * F.col("words")) / (F.col("words") + PAD)).alias("evidence"))
    seen = rows.where("label IS NOT NULL AND evidence IS NOT NULL").groupBy(
        F.round(F.greatest(F.least(F.col("evidence"), F.lit(LIMIT)), F.lit(-LIMIT)) / BIN).cast("long").alias("bin"), "label").count().collect()
    if len({r["label"] for r in seen}) < 2:
        centres, values = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
    else:
        by: dict[int, list[float]] = {}
        for r in seen:
            at = by.setdefault(r["bin"], [0.0, 0.0])
            at[0] += r["label"] * r["count"]
            at[1] += r["count"]
        n = np.array([v[1] for v in by.values()])
        centres, values = isotonic(np.array([*by], dtype=float) * BIN, np.array([v[0] for v in by.values()]) / n, n)

    @F.pandas_udf("double")
    def curve(evidence: pd.Series) -> pd.Series:
        e = evidence.fillna(0.0).to_numpy(dtype=float)
        # a trace of the evidence itself keeps the order within a step
        return pd.Series(np.round((1 - TRACE) * np.interp(e, centres, values) + TRACE / (1 + np.exp(-np.clip(4 * e, -30, 30))), 9))

    return rows.select("doc_id", curve("evidence").alias("score"))
