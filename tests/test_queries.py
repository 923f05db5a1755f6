"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "shape", ()) != ():
        return str([cell(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    return f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
