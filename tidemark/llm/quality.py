"""Quality by naive Bayes support vectors.

Texts become indicators of n-grams of shapes over all parts of the text (runs of letters by case, runs of digits,
each mark; with a space before or not), of repeated neighbours and of length in characters. Each indicator is scaled by its log-count ratio between the two labels, and a linear
model with the hinge loss is fitted to the scaled indicators by dual coordinate descent. Scores are
the logistic of the margin, with slope and shift fitted to margins of folds left out in turn.

Results for odd input: null and empty texts get the score of a text with the one feature "empty"; without
labels of both kinds every score is the share of good labels (0.5 if there are none); one row is
given for each row of documents, repeated and null ids included.
"""

from __future__ import annotations

import re
from itertools import chain
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .fitting import choose, first_by_hash, labelled, margins, matrix, scored

_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


class _Shapes(dict):
    """Shapes of all parts of a word, the first with a space before it; short words are kept while there are not too many of them."""

    def __missing__(self, word: str) -> list[str]:
        parts = [("A" if x.isupper() and len(x) > 1 else "Aa" if x[0].isupper() else "a") if x[0].isalpha() else "0" if x[0].isdigit() else x for x in _PART.findall(word)]
        if parts:
            parts[0] = " " + parts[0]
        if len(word) > 40:
            return parts
        if len(self) > 200_000:
            self.clear()
        self[word] = parts
        return parts


_shapes = _Shapes()


def features(text: str) -> set[str]:
    """Distinct shapes, pairs and triples of neighbouring shapes, how often a part repeats the one before it, and a short length."""
    words = text.split()
    if not words:
        return {"empty"}
    shapes = list(chain.from_iterable([_shapes[w] for w in words]))
    out = set(shapes)
    out.update(map("|".join, set(zip(shapes, shapes[1:], strict=False))), map("|".join, set(zip(shapes, shapes[1:], shapes[2:], strict=False))))
    if len(words) < len(shapes) / 20:  # hardly any spaces: parts stand for words
        words = [x for x in _PART.findall(text) if x[0].isalnum()] or words
    again = sum(map(eq, words, words[1:])) / len(words)
    out.update(f"again>{x}" for x in (0, 0.02, 0.1, 0.3) if again > x)
    size = sum(map(len, words)) if len(words) < 250 else 250
    out.update(f"characters<{x}" for x in (25, 100, 250) if size < x)
    return out


def log_count_ratio(flat: np.ndarray, at: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """log of the smoothed share of each indicator among good rows over that among the others."""
    row = np.repeat(y, np.diff(at))
    p, q = 1 + np.bincount(flat[row == 1], minlength=size), 1 + np.bincount(flat[row == 0], minlength=size)
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(flat: np.ndarray, at: np.ndarray, y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias over indicators times ``scale``: one dual variable per row, in [0, cost of its label]."""
    w, bias = np.zeros(len(scale)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, cost, cost * max(1.0, (y == 1).sum() / max(1, (y == 0).sum())) ** 0.5)
    norm = margins(scale**2, flat, at) + 1
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = flat[at[i] : at[i + 1]]
            x = scale[f]
            new = min(max(alpha[i] - (sign[i] * (w[f] @ x + bias) - 1) / norm[i], 0.0), upper[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[f] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of ``y`` over ``margin``, by Newton steps with smoothed targets."""
    t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    x, a = np.stack((margin, np.ones(len(y)))), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (t - p))
        a = a + np.clip(step, -2, 2)
    return float(max(a[0], 1e-3)), float(a[1])


def quality(docs: DataFrame, labels: DataFrame, rows: int = 12_000, vocabulary: int = 20_000, folds: int = 4) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs`` (doc_id, text).

    Fits on at most ``rows`` labelled texts of the learning folds, with at most ``vocabulary`` features.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled(labels, "quality", fold("doc_id", 5) != 0)
    share = known.agg(F.avg("y")).first()[0]
    picked = first_by_hash(known.select("doc_id"), rows).join(known, "doc_id")
    sample = docs.join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows of 12 bytes
    chosen = choose(sample, features, 3, vocabulary)
    if not chosen:
        share = min(max(0.5 if share is None else share, 1e-9), 1 - 1e-9)
        out = scored(docs, features, {}, float(np.log(share / (1 - share))))
    else:
        index = {x: i for i, x in enumerate(chosen)}
        flat, at, y = matrix(sample, features, index)
        left = np.zeros(len(y))
        part = np.random.default_rng(11).permutation(len(y)) % folds
        for k in range(folds):
            some = np.flatnonzero(part != k)
            sub = np.concatenate([flat[at[i] : at[i + 1]] for i in some]), np.concatenate(([0], np.cumsum(np.diff(at)[some])))
            r = log_count_ratio(*sub, y[some], len(chosen))
            w, b = dual_descent(*sub, y[some], r, epochs=6)
            left[part == k] = (margins(w * r, flat, at) + b)[part == k]
        slope, shift = logistic(left, y)
        r = log_count_ratio(flat, at, y, len(chosen))
        w, b = dual_descent(flat, at, y, r)
        out = scored(docs, features, {x: float(w[i] * r[i]) for x, i in index.items()}, b, slope, shift)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
