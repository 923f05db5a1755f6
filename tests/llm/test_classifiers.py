"""Held-out accuracy, learning folds, and odd rows of the classifiers."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.language import Space, grams, languages
from tidemark.llm.quality import dual_descent, features, log_count_ratio, quality
from tidemark.llm.toxicity import nn_pu, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (None, "", "en"), (1, " \n ", "en"), (1, "word " * 30000, "de"), (5, "the cat and the dog", "en"), (6, "1234 !!", "en")]
ODD_KIND = "doc_id long, text string, lang string"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("run,column,limit,sf", [(toxicity, "toxic", 0.5, "sf0.1"), (quality, "quality", 0.3, "sf0.01")])
def test_held_out(spark, run, column, limit, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    y = {r.doc_id: r[column] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= limit)
    held = [(y[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    truth, score, guess = map(np.array, zip(*held, strict=True))
    print(column, "auc", auc(truth, score), "right", (truth == guess).mean(), "recall", guess[truth == 1].mean(), "false", guess[truth == 0].mean())
    assert auc(truth, score) >= 0.9
    assert (truth == guess).mean() >= 0.9


@pytest.mark.parametrize("run,column", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, run, column):
    docs = spark.createDataFrame(ODD, ODD_KIND).withColumn("score", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1)], f"doc_id long, {column} int")
    assert len(run(docs, labels).collect()) == len(ODD)
    assert len(run(docs, labels.limit(0)).collect()) == len(ODD)
    assert run(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_non_negative_risk_finds_the_hidden_positives():
    rng = np.random.default_rng(1)
    truth = rng.random(600) < 0.3
    found = [np.flatnonzero(rng.random(20) < (0.5 if t else 0.1)) for t in truth]
    positive = truth & (rng.random(600) < 0.4)
    at = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    w, bias = nn_pu(np.concatenate(found), at, positive, 0.3, 20)
    score = np.array([w[x].sum() + bias for x in found])
    assert auc(truth.astype(int), score) > 0.95


def test_dual_descent_separates():
    flat, at, y = np.array([0, 1, 0, 2, 3, 2]), np.array([0, 2, 3, 5, 6]), np.array([1, 1, 0, 0])
    r = log_count_ratio(flat, at, y, 4)
    w, b = dual_descent(flat, at, y, r)
    margin = [(w[flat[at[i] : at[i + 1]]] * r[flat[at[i] : at[i + 1]]]).sum() + b for i in range(4)]
    assert min(margin[:2]) > 0.9
    assert max(margin[2:]) < -0.9


def test_language_held_out_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in languages(docs).collect()}
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if rows[r.doc_id].held_out and r.lang]
    print("language right", np.mean([a == b for a, b in held]))
    assert np.mean([a == b for a, b in held]) >= 0.95
    odd = languages(spark.createDataFrame(ODD, ODD_KIND).withColumn("lang_pred", F.lit(1))).collect()
    assert len(odd) == len(ODD)
    assert sorted(r.lang_pred for r in odd).count("und") == 4
    assert languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters():
    space = Space(64, 3)
    code, count = grams("abab", 3)
    want = sum(n * np.prod([np.roll(space.placed[2][(c // 4096 ** (2 - k)) % 4096], 2 - k) for k in range(3)], axis=0) for c, n in zip(code, count, strict=True))
    assert np.allclose(space.bundles(["abab"])[0], want)


def test_quality_reads_texts_without_spaces_to_their_end(spark):
    start = "春眠不覺曉,處處聞啼鳥。夜來風雨聲,花落知多少。" * 20
    assert not any(x.startswith(("words<", "characters<")) for x in features(start))
    assert features("春眠。") - features(start)
    assert features(start + "###") - features(start)
    assert "again>0.3" in features("春眠。" * 200)
    docs = spark.createDataFrame([(k, start + ("###%%%" if k % 2 else "花落。") * (1 + k % 3)) for k in range(80)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in quality(docs, docs.selectExpr("doc_id", "1 - int(doc_id % 2) as quality")).collect()}
    assert min(v for k, v in score.items() if k % 2 == 0) > max(v for k, v in score.items() if k % 2)


def test_bundles_of_long_and_varied_texts_stay_small():
    import tracemalloc

    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 5_000_000)))
    space = Space(256, 3)
    tracemalloc.start()
    out = space.bundles([text, *[text[k * 30_000 : (k + 1) * 30_000] for k in range(64)], None])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000
    assert (out[-1] == 0).all() and np.array_equal(out[5], space.bundles([text[120_000:150_000]])[0])
