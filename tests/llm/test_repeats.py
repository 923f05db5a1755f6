import hashlib
import re
from collections import Counter

from tidemark.llm import queries, repeats
from tidemark.llm.repeats import remove_repeats

SF = "/root/testdata/sf0.01"


def brute(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_matches_all_windows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    local = rows.collect()
    want = dict(zip([r.doc_id for r in local], brute([r.text for r in local])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(rows).collect()}
    assert got == want
    assert sum(n > 0 for _, n, _ in want.values()) > 50


def test_short_windows_and_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c d e f", "x a b c d e y", "q q q q q q q q q", "a  b\tc d", "one two three", "one two three", "é " * 3, "long " + " ".join(f"w{i}" for i in range(20000)), "w5 w6 w7 w8 w9", "A b c d"]
    docs = spark.createDataFrame([(i if i else None, t, "key", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_words int")
    got = {r.doc_id or 0: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, 4).collect()}
    assert got == dict(enumerate(brute(texts, 4)))
    left = {r.doc_id or 0: (r.text, r.key) for r in remove_repeats(docs, 4).collect()}
    assert left[4] == ("x y", "key") and left[5][0] == "" and left[7][0] == "one two three"
    assert remove_repeats(docs.limit(0)).count() == 0


def test_heavy_hashes_and_sql(spark, monkeypatch):
    """A passage that most texts share, with heavy hashes from three rows on; DuckDB's SQL gives the same rows."""
    import duckdb
    import pyarrow as pa

    monkeypatch.setattr(repeats, "LIGHT_ROWS", 3)
    monkeypatch.setattr(repeats, "HEAVY", 10**9)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"own {i} {passage} end {i % 7}" if i % 3 else " ".join(f"w{i % 20}_{k}" for k in range(50)) + f" {i}" for i in range(120)]
    rows = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {r.doc_id: tuple(r[1:]) for r in rows} == dict(enumerate(brute(texts)))
    documents = pa.table({"doc_id": list(range(120)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(queries.oracle_sql()["op8_substring_dedup"]).fetchall()) == sorted(map(tuple, rows))
