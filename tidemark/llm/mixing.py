"""Mixing a corpus to target weights with soft domain membership, in DataFrame functions only.

A labelled table names the domain of some documents. Naive Bayes over hashed words and word endings
learns from a bounded sample of them and gives every document posteriors p over the domains. Document rates
r >= 0 are then fitted so that the expected tokens of each domain, the sum of r * tokens * p, come to
its target: projected-gradient least squares from the rate 1, where every step is one distributed sum over all
documents. The gradient is taken in the metric of tokens and scaled by the Gram matrix of the posteriors of rates
above 0 (domains by domains, so small), which lets rare domains converge as fast as common ones. Every row says how far the shares
stay from the targets (miss).

Results for odd input: null or blank texts have no tokens, prior posteriors, and keep the rate that their
posteriors give; if a target has no document at all, the rates come as near as they can; of equally likely domains the first by name is named; without labels there is one domain
"unknown" and every rate is 1.0; one row is given for each row of documents, repeated and null ids included.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .fitting import first_by_hash

BUCKETS = 4096
_SPACES = r"[\x20\x09-\x0D]+"


def _words(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each word, with its bucket and that of its ending; a row without a word for blank texts."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int") + 1
    words = docs.select(*columns, F.explode_outer(F.split(F.lower("text"), _SPACES)).alias("word"))
    return words.select(*columns, F.coalesce(F.length("word") > 0, F.lit(False)).alias("is_word"), bucket(F.col("word")).alias("b"), bucket(F.substring("word", -2, 2)).alias("e"))


def _table(values: list[float]) -> Column:
    """A constant array; one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def posteriors(docs: DataFrame, labelled: DataFrame, rows: int = 20_000, sharpness: float = 60.0) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p0, p1, ...) for every row of ``docs``, and the domains in order.

    Learns from at most ``rows`` labelled documents. The evidence is the mean over a document's words, weighed as
    ``sharpness`` words, so that long texts stay soft.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = first_by_hash(known.select("doc_id"), rows).join(known, "doc_id")
    sample = docs.join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows of an id and a name
    counts = {name: {} for name in "be"}
    for name in counts:
        for r in _words(sample, "domain").where("is_word").groupBy("domain", name).count().collect():  # domains x BUCKETS rows at most
            counts[name].setdefault(r["domain"], {})[r[name]] = r["count"]
    sizes = {r["domain"]: r["count"] for r in picked.groupBy("domain").count().collect()}
    domains = sorted(counts["b"])
    weights: list[Column] = []
    for d in domains:
        parts = []
        for name in "be":
            total = sum(counts[name][d].values())
            parts.append([math.log((counts[name][d].get(i, 0) + 0.5) / (total + 0.5 * BUCKETS)) for i in range(1, BUCKETS + 1)])
        weights.append(F.element_at(_table(parts[0]), F.col("b")) + F.element_at(_table(parts[1]), F.col("e")))
    word_rows = _words(docs.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id")
    sums = [F.sum(F.when(F.col("is_word"), w)).alias(f"s{k}") for k, w in enumerate(weights)]
    by_doc = word_rows.groupBy("row", "doc_id").agg(F.count_if("is_word").alias("n_tokens"), *sums)
    if not domains:
        return by_doc.select("doc_id", "n_tokens", F.lit(1.0).alias("p0")), ["unknown"]
    priors = [math.log((sizes[d] + 1) / (sum(sizes.values()) + len(domains))) for d in domains]
    logits = [F.lit(priors[k]) + F.lit(sharpness) * F.coalesce(F.col(f"s{k}") / F.col("n_tokens"), F.lit(0.0)) for k in range(len(domains))]
    by_doc = by_doc.select("doc_id", "n_tokens", *[x.alias(f"l{k}") for k, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("l0")
    raised = by_doc.select("doc_id", "n_tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"x{k}") for k in range(len(domains))])
    whole = _sum([F.col(f"x{k}") for k in range(len(domains))])
    return raised.select("doc_id", "n_tokens", *[(F.col(f"x{k}") / whole).alias(f"p{k}") for k in range(len(domains))]), domains


def fit_rates(soft: DataFrame, targets: list[float], steps: int = 60, tolerance: float = 1e-7, patience: int = 12) -> DataFrame:
    """``soft`` with a rate for each row, such that the sums of rate * n_tokens * p match ``targets`` (shares of all tokens), and the miss.

    ``miss`` is the largest distance of a share from its target, the same in every row: above ``tolerance`` the targets cannot be met by
    nonnegative rates, or not within ``steps``; the rates are then those of the least sum of squares that was seen. A step that makes
    the sum more than twice the least is taken back and damped; ``patience`` steps without gain end the fit.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    tokens = F.col("n_tokens")
    totals = [F.sum(F.col("rate") * tokens * p[i]) for i in range(k)]
    gram = [F.sum(F.when(F.col("rate") > 0, tokens * p[i] * p[j])) for i in range(k) for j in range(i, k)]
    now = base = best = soft.withColumn("rate", F.lit(1.0))
    least, far, damp, idle, taken = math.inf, math.inf, 1e-9, 0, 0
    for _ in range(steps):
        got = [float(x or 0.0) for x in now.agg(F.sum(tokens), *totals, *gram).first()]
        if not got[0]:
            return now.withColumn("miss", F.lit(None).cast("double"))
        miss = np.array(got[1 : k + 1]) / got[0] - np.array(targets)
        square = float(miss @ miss)
        idle = idle + 1 if square > least * (1 - 1e-6) else 0
        if square < least:
            least, far, best = square, float(np.abs(miss).max()), now
        if far <= tolerance or idle >= patience:
            break
        if square <= 2 * least + 1e-12:
            base, at, damp, taken = now, miss, max(damp / 3, 1e-9), taken + 1
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = np.array(got[k + 1 :]) / got[0]
            m = m + m.T - np.diag(np.diag(m))
            if taken % 8 == 0:
                base = written(base)
        else:
            damp = max(damp * 30, 1e-5)
        move = np.linalg.solve(m + damp * np.eye(k), at)
        now = base.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - _sum([p[i] * float(move[i]) for i in range(k)])))
    return best.withColumn("miss", F.lit(far))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **settings) -> DataFrame:
    """Rows (doc_id, n_tokens, domain, posterior, rate, expected_tokens, miss), one for each row of ``docs`` (doc_id, text).

    ``labelled`` holds (doc_id, domain); ``targets`` the wanted shares of tokens, scaled to sum to 1, 0 for other domains.
    ``domain`` is the likeliest one, and ``posterior`` maps every domain to its probability.
    """
    soft, domains = posteriors(docs, labelled, **settings)
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    soft = written(soft)
    rated = fit_rates(soft, [x / sum(wanted) for x in wanted]) if sum(wanted) > 0 and domains != ["unknown"] else soft.withColumn("rate", F.lit(1.0)).withColumn("miss", F.lit(None).cast("double"))
    p = [F.col(f"p{i}") for i in range(len(domains))]
    best = F.array_max(F.array(*[F.struct(x.alias("p"), F.lit(-i).alias("i")) for i, x in enumerate(p)]))
    named = F.element_at(F.array(*[F.lit(d) for d in domains]), 1 - best["i"])
    both = [x for i, d in enumerate(domains) for x in (F.lit(d), p[i])]
    return rated.select("doc_id", "n_tokens", named.alias("domain"), F.create_map(*both).alias("posterior"), "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"), "miss")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else junk or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
