"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; a bounded sample of texts, labels ignored, is the unlabelled
side. A linear model over present words and word beginnings is trained with the class-prior corrected
risk  prior * R+(P) + max(0, R-(U) - prior * R-(P)):  while the corrected negative risk is below zero, the
step goes against it, so that the model does not learn the unlabelled positives as negatives.

Results for odd input: null and empty texts get the score of a text without any feature; without
toxic examples or unlabelled texts every score is 0.0; one row is given for each row of documents,
repeated and null ids included.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .fitting import choose, first_by_hash, labelled, margins, matrix, scored

_WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """Distinct lower-case words, the beginnings of four to six letters of longer ones, and beginnings that two or more words share."""
    words = set(_WORD.findall(text.lower()))
    out = words.union([w[:4] + "-" for w in words if len(w) > 4], [w[:6] + "-" for w in words if len(w) > 6])
    for start, n in Counter([w[:5] for w in words if len(w) > 5]).items():
        out.add(start + "-")
        if n > 1:
            out.add(start + "-2")
            if n > 2:
                out.add(start + "-3")
    return out


def nn_pu(flat: np.ndarray, at: np.ndarray, positive: np.ndarray, prior: float, size: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam steps over the whole sample."""
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    row = np.repeat(np.arange(len(positive)), np.diff(at))
    n_p, n_u = positive.sum(), (~positive).sum()
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        g = margins(w[:size], flat, at) + w[size]
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        as_negative = np.logaddexp(0, g)  # loss of calling it negative
        rest = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        pull = np.where(positive, -prior * s / n_p, s / n_u)  # gradient of the corrected negative risk
        slope = -pull if rest < 0 else pull + np.where(positive, -prior * (1 - s) / n_p, 0.0)
        grad = np.append(np.bincount(flat, slope[row], size), slope.sum()) + decay * np.append(w[:size], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 6_000, unlabelled: int = 12_000, vocabulary: int = 20_000) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs`` (doc_id, text).

    Fits on at most ``positives`` toxic and ``unlabelled`` other texts of the learning folds, with at
    most ``vocabulary`` features. The prior is the toxic share of the labels of these folds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = fold("doc_id", 5) != 0
    known = labelled(labels, "toxic", learn)
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    toxic = first_by_hash(known.where("y = 1").select("doc_id"), positives)
    other = first_by_hash(docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").join(F.broadcast(toxic), "doc_id", "left_anti"), unlabelled)
    ids = toxic.withColumn("y", F.lit(1)).unionAll(other.withColumn("y", F.lit(0)))
    sample = docs.join(F.broadcast(ids), "doc_id")  # at most positives + unlabelled rows of 12 bytes
    chosen = choose(sample, features, 5, vocabulary, clear=5.0) if 0 < prior < 1 else []
    weights, bias = {}, -40.0
    if chosen:
        index = {x: i for i, x in enumerate(chosen)}
        flat, at, y = matrix(sample, features, index)
        w, bias = nn_pu(flat, at, y == 1, float(prior), len(chosen))
        weights = {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}
    out = scored(docs, features, weights, bias)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose document is predicted toxic; rows with null ids stay."""
    bad = toxicity(docs, labels, **settings).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
