import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.embedding_links import audit_share, near_vectors, range_search, robust_prune, twins

SF = "/root/testdata/sf0.01"


def brute(ids, x, least=0.95):
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    u = np.where(good[:, None], x / np.where(good, norm, 1)[:, None], 0.0)
    link = (u @ u.T >= least) & good[:, None] & good[None, :]
    np.fill_diagonal(link, False)
    root = ids.copy()
    while True:
        low = np.array([min(root[i], root[link[i]].min(initial=root[i])) for i in range(len(ids))])
        if (low == root).all():
            return {int(i): (int(n), int(r)) for i, n, r in zip(ids, link.sum(axis=1), root, strict=True)}
        root = low


@pytest.mark.parametrize("settings", [{}, {"shard": 60, "overlap": 3}])
def test_against_all_pairs(spark, settings):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    if settings:  # a dense group that one piece does not hold
        rng = np.random.default_rng(2)
        center = rng.normal(size=64)
        more = [(10_000 + i, [float(v) for v in np.float32(center + 0.15 * rng.normal(size=64))]) for i in range(300)]
        df = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(more, "vec_id long, embedding array<float>"))
        rows = df.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, **settings).collect()}
    assert got.keys() == want.keys()
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.01 * len(want), [(k, got[k], want[k]) for k in wrong[:5]]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [1.0, 0.1]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [1e300, 1e300]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit(1))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 9, 10)]
    assert got == sorted([(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (8, 3, 1, False), *alone])
    assert near_vectors(df.limit(0)).count() == 0


def test_pruned_graph_finds_all_in_range():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.25 * rng.normal(size=(40, 16)) for c in rng.normal(size=(20, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = robust_prune(x @ x.T, 16, 1.2)
    found = sum(len(range_search(x, lists, q, 0, 0.95, 0.1, 32)) for q in x)
    assert found >= 0.99 * (x @ x.T >= 0.95).sum()


def test_dense_groups_apart(spark):
    """Groups of more vectors than the nearest candidates, far from each other and from the medoid."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.1 * rng.normal(size=(150, 32)) for c in rng.normal(size=(6, 32))] + [rng.normal(size=(40, 32))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()} == brute(np.arange(len(x)), x)


def test_failed_audit_compares_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 32))
    x[700:] = x[:100] + 0.05 * rng.normal(size=(100, 32))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_vectors(df, shard=120, recall=2.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(np.arange(len(x)), x)


def test_twins_are_found_and_leave_no_trace(spark):
    """A table without any link: the audit has links all the same, a passed one decides, and no count or component shows the twins."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 48))
    names, made = twins(np.arange(900), x / np.linalg.norm(x, axis=1)[:, None], 0.95)
    cos = (made * x).sum(axis=1) / np.linalg.norm(x, axis=1)
    assert len(set(names.tolist())) == 900 and cos.min() >= 0.95 and cos.max() < 1 and cos.min() < 0.953
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.vec_id == r.component_id, r.n_links) for r in near_vectors(df, shard=120).collect()} == {(True, 0)}


def test_audit_weighs_small_groups():
    truth = {k: (90, 90) for k in range(90)} | {100 + k: (1, 1) for k in range(2)}
    assert audit_share(truth, {k: 90 for k in range(90)}) < 0.6
    assert audit_share(truth, {k: n for k, (n, _) in truth.items()}) > 1 - 1e-9
    assert audit_share({}, {}) == 1.0
