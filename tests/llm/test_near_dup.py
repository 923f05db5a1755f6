import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.llm import near_dup, queries
from tidemark.llm.near_dup import near_duplicates, one_of_each

SF = "/root/testdata/sf0.01"


def brute(rows, percent=75):
    """Sets and components by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == want
    assert sum(not k for _, _, k in want.values()) > 20


def test_large_group_of_near_copies_and_deep_nodes(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 50], f"x{i}"])) for i in range(40)]  # all near copies of one another
    rows += [(100 + i, " ".join([*words[:30], *[f"y{i}_{k}" for k in range(30)]])) for i in range(30)]  # share a passage only
    rows += [(200 + i, " ".join([*words[:30], *[f"y{i}_{k}" for k in range(30)], "z"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, leaf=4).collect()}
    assert got == brute(rows)


def crowd(n, shared, seed):
    """``n`` texts of 60 words that share a passage of ``shared`` words; every second one is a near copy of the one before."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        own = [f"u{seed}_{i}_{k}" for k in range(60 - shared)] if i % 2 == 0 else own[:-rng.randint(0, 9)] or own
        rows.append((seed * 1000 + i, " ".join([*[f"p{seed}_{k}" for k in range(shared)], *own])))
    return rows


def test_crowded_nodes_branch_and_end_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rows = crowd(120, 40, 1) + crowd(120, 46, 2) + crowd(60, 20, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) > 100
    for settings in ({"leaf": 8}, {"leaf": 30, "depth": 1}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **settings).collect()}
        assert got == want


def test_recall_of_pairs_at_the_threshold(spark):
    """400 pairs of 75 to 76 % in a crowd that shares 44 % of every text; all are found."""
    rows = []
    for i in range(400):
        own = [f"{i}_{k}" for k in range(56)]
        rows += [(2 * i, " ".join([*[f"p{k}" for k in range(48)], *own])), (2 * i + 1, " ".join([*[f"p{k}" for k in range(48)], *own[:-14], *[f"{i}x{k}" for k in range(14)]]))]
    want = brute(rows[:4])
    assert [c for _, c, _ in want.values()] == [0, 0, 2, 2]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=64).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_links_of_repeated_ids(spark):
    a = [f"w{i}" for i in range(41)]
    for k in range(3):
        rows = [(1, " ".join(a)), *[(1, f"other {k} {j} text of this id with some words") for j in range(4)], (2, " ".join([*a[:-2], "x", "y"]))]
        got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 1)] * 5 + [(2, 1)]


def test_forest_takes_earlier_edges_and_spans():
    a, b = np.array([0, 1, 0, 3, 2]), np.array([1, 2, 2, 4, 1])
    assert sorted(near_dup.forest(a, b, 6).tolist()) == [0, 1, 3]
    assert near_dup.forest(a[:0], b[:0], 3).tolist() == []


def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op5_minhash_near_dup"]).fetchall()
    got = queries.queries()["op5_minhash_near_dup"](spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 200


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n ", 1), (4, "a b", 1), (5, "A  b\n", 1), (6, "a b c", 1), (None, "a b", 1), (8, "a b c d e f", 1), (8, "a b c d e f", 1), (9, "x " * 30000, 1), (10, "É b", 1), (11, "é b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=lambda x: x[0])
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (8, 2, 8, True), (8, 2, 8, True), (9, 1, 9, True), (10, 1, 10, True), (11, 1, 11, True)]
    assert {r.doc_id for r in one_of_each(docs).collect()} == {None, 1, 2, 3, 4, 6, 8, 9, 10, 11}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.EDGES", 20)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i % 7, 207 + i) for i in range(40)] + [(207, 230), (208, 229)]
    top = {n: n for e in edges for n in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}


def test_all_rows_are_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.lit("one and the same text of many rows"))
    assert near_duplicates(docs).where("kept").count() == 1
