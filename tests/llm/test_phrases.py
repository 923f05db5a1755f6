"""Collocations against a plain count, at several thresholds, with maps that say nothing and long pieces."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_queries import duck, rows  # noqa: F401
from tidemark.llm import phrases
from tidemark.llm.phrases import collocations, frequencies, pieces
from tidemark.llm.queries import OP11_SQL, op11_collocations

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs, most):
    out = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    out[lang or "und", tuple(words[i : i + n])] += 1
    return out


def plain(docs, most, least, top, percent):
    f, out = counts(docs, most), []
    frequent = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    for lang in {k[0] for k in f}:
        n = sum(a for k, a in f.items() if k[0] == lang and len(k[1]) == 1)
        found = []
        for (where, ws), a in frequent.items():
            if where != lang:
                continue
            if any(x == lang and len(w) > len(ws) and 100 * b >= percent * a and any(w[i : i + len(ws)] == ws for i in range(len(w))) for (x, w), b in frequent.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            found.append((-score, -a, " ".join(ws).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


DOCS = [
    ("en", "The cat sat on the mat. The cat sat on  the\tmat, the CAT ran!"), ("en", "the the the the\nthe the"), (None, "eins zwei drei; eins zwei drei"), (None, None), ("en", ""), ("fr", "été là été là, été là"),
    ("en", " . , ;"), ("und", "eins zwei drei"), ("en", "sat on the " * 40), ("en", "zz\x0bzz zz\x0c a b c d e f a b c d e f a b c d e f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(DOCS)], "doc_id long, text string, lang string, phrase string").repartition(4)


@pytest.mark.parametrize("most, least, top, percent", [(5, 2, 2000, 100), (5, 3, 4, 60), (2, 2, 2000, 100), (3, 1, 2000, 100)])
def test_equals_the_plain_version(docs, most, least, top, percent):
    got = sorted(tuple(r) for r in collocations(docs, most, least, top, percent).collect())
    assert got == plain(DOCS, most, least, top, percent)


def test_a_full_bit_map_changes_nothing(docs):
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequencies(docs, 5, 2, bits=64).where("phrase <> ''").collect()}
    assert got == {k: a for k, a in counts(DOCS, 5).items() if a >= 2}


def test_small_blocks_and_buckets_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(phrases, "BYTES", 20)
    monkeypatch.setattr(phrases, "ROWS", 3)
    batches = pieces(docs).toArrow().to_batches(3)
    got = Counter()
    for batch in phrases._grams(1, 5, 7, None, None)(iter(batches)):
        assert batch.column("bucket").to_pylist() == sorted(batch.column("bucket").to_pylist()) and max(batch.column("bucket").to_pylist()) < 7
        for row in phrases._unpacked(batch).to_pylist():
            for phrase, f in zip(row["phrases"].split("\n"), row["fs"], strict=True):
                got[row["lang"], tuple(phrase.split(" "))] += f
    assert got == counts(DOCS, 5)


def test_long_pieces_are_counted_across_their_stretches():
    text = " ".join(f"w{i % 7}" for i in range(500))
    parts = list(phrases._parts(text, 4, 100))
    assert len(parts) > 10
    want, got = Counter(), Counter()
    words = text.split(" ")
    for n in range(1, 6):
        for i in range(len(words) - n + 1):
            want[tuple(words[i : i + n])] += 1
        for part, tail in parts:
            own = part.split(" ")
            for i in range(len(own) - tail):
                if i + n <= len(own):
                    got[tuple(own[i : i + n])] += 1
    assert got == want


def test_counts_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000_000
    known = spark.createDataFrame([("en", "", 3 * big), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "frequencies", lambda *_: known)
    row = collocations(known).collect()[0]
    assert row.score == 1000 * (big - 7) * 3 * big // (big * (big + 1))


def test_empty_and_pieces(spark, docs):
    assert collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert {(r.piece, r.c) for r in pieces(docs).where("lang = 'und'").collect()} == {("eins zwei drei", 3)}
    assert pieces(docs).where(F.col("piece") == "").count() == 0


def test_query_equals_sql(spark, duck):  # noqa: F811
    assert rows(op11_collocations(spark, SF).toPandas()) == rows(duck.execute(OP11_SQL).fetchdf())
