import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.mixing import BUCKETS, fit_rates, label_domains, mix, posteriors

SF = "/root/testdata/sf0.001"


def test_posteriors_match_counts_by_hand(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words !!"), (3, "good good"), (4, ""), (5, None), (6, "words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, None), (None, "a")], "doc_id long, domain string")
    soft, domains = posteriors(docs, labels, sharpness=5.0)
    assert domains == ["a", "b"]
    words = {w for r in docs.collect() for w in (r.text or "").split()}
    parts = words | {w[-2:] for w in words}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in parts], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).collect()}
    train = {"a": "good words here good good".split(), "b": "bad words !!".split()}

    def log_p(d, w):
        out = 0
        for cut in (lambda x: x, lambda x: x[-2:]):
            c = Counter(bucket[cut(x)] for x in train[d])
            out += math.log((c[bucket[cut(w)]] + 0.5) / (len(train[d]) + 0.5 * BUCKETS))
        return out

    for r in soft.collect():
        text = {1: "good words here", 2: "bad words !!", 3: "good good", 6: "words"}.get(r.doc_id, "").split()
        logit = [math.log(n / 5) + 5 * (sum(log_p(d, w) for w in text) / len(text) if text else 0) for d, n in (("a", 3), ("b", 2))]
        assert r.n_tokens == len(text)
        assert abs(r.p0 - 1 / (1 + math.exp(logit[1] - logit[0]))) < 1e-6


def test_rates_meet_targets_and_are_least_squares(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.2, 0.1], 400)
    n = rng.integers(1, 900, 400)
    soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(400)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    for target in ([0.2, 0.3, 0.5], [0.9, 0.09, 0.01], [0.34, 0.33, 0.33]):
        r = np.array([x.rate for x in fit_rates(soft, target).orderBy("doc_id").collect()])
        assert r.min() >= 0
        assert np.allclose((r * n) @ p / n.sum(), target, atol=1e-5)


def least_squares(p, n, target, steps=8000):
    """Accelerated projected gradient with short steps: a plain version to hold the fit against."""
    a = (p * n[:, None] / n.sum()).T
    r = y = np.ones(len(n))
    size, t = 1 / np.linalg.norm(a @ a.T, 2), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - size * a.T @ (a @ y - target))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        r, y, t = new, new + (t - 1) / after * (new - r), after
    return float(((a @ r - target) ** 2).sum())


def test_unreachable_targets_come_as_near_as_least_squares(spark):
    rng = np.random.default_rng(1)
    for p, target in ((rng.dirichlet([2, 2, 2], 200) * 0.6 + np.array([0.4, 0, 0]), [0.1, 0.45, 0.45]), (rng.dirichlet([5, 5, 5], 200), [0.98, 0.01, 0.01])):
        n = rng.integers(1, 900, 200)
        soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
        out = fit_rates(soft, target).orderBy("doc_id").collect()
        off = (np.array([x.rate for x in out]) * n) @ p / n.sum() - target
        assert abs(out[0].miss - np.abs(off).max()) < 1e-9 and out[0].miss > 1e-3
        assert float(off @ off) <= least_squares(p, n.astype(float), np.array(target)) * 1.02 + 1e-7


def test_query_tables_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    targets = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}
    rows = mix(docs.withColumn("domain", F.lit(3)).withColumn("rate", F.lit(1)), labels, targets).collect()
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == docs.count()
    for d, share in targets.items():
        assert abs(sum(r.expected_tokens * r.posterior[d] for r in rows) / total - share) < 1e-4
    assert mix(docs.limit(0), labels, targets).count() == 0
    assert {r.rate for r in mix(docs, labels.limit(0), targets).collect()} == {1.0}
    odd = spark.createDataFrame([(None, None), (None, ""), (1, " \n"), (1, "x " * 40000)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in mix(odd, labels, targets).collect()) == [0, 0, 0, 40000]
