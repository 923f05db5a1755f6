"""Fill-in-the-middle against a plain version, and texts rebuilt from output and form."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.test_queries import duck, rows  # noqa: F401
from tidemark.llm import middle_fill
from tidemark.llm.middle_fill import BLOCK, fill_middle, restored
from tidemark.llm.queries import OP12_SQL, op12_fill_middle

SF = "/root/testdata/sf0.001"


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(middle_fill.TOKEN, text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "<P>", "a<S>b", "x" * (3 * BLOCK), ("é" + "ab" * 40 + "\n") * 500, "日本 <\x00\t", "<", "P><", "a<" * 50, "\U0001f600" * (2 * BLOCK) + "z"]


def test_odd_texts_equal_the_plain_version(spark):
    data = [(i, t, "clash") for i in [*range(40), None] for t in ODD]
    docs = spark.createDataFrame(data, "doc_id long, text string, form string").repartition(3)
    out = fill_middle(docs)
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=key) == sorted((plain(i, t) for i, t, _ in data), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = [r[0] for r in out.select(restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(back) == sorted(t or "" for _, t, _ in data)


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    found = {r.form: r["count"] for r in fill_middle(docs, plain=50, spm=40).groupBy("form").count().collect()}
    assert abs(found["plain"] - 2000) < 150 and abs(found["spm"] - 800) < 120


def test_empty_table(spark):
    assert fill_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark, duck):  # noqa: F811
    assert rows(op12_fill_middle(spark, SF).toPandas()) == rows(duck.execute(OP12_SQL).fetchdf())


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_blocks_cut_between_tokens(size):
    text = "ab cd--efgh\n\nx" * 9
    ends = list(middle_fill.blocks(text, size))
    assert "".join(text[a:b] for a, b in ends) == text
    assert [t for a, b in ends for t in re.findall(middle_fill.TOKEN, text[a:b])] == re.findall(middle_fill.TOKEN, text)
