"""The driver contract: entry(), queries() and oracle_sql(), checked against
DuckDB on the smallest data directory (columns sorted by name, rows as a
multiset), as the driver does."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from quarry.plans.catalog import QUERIES
from quarry.plans.oracle import SQL
from tests.conftest import SF_SMALL

TABLES = ("documents embeddings pages benchmark labels events").split()


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "doc_id", "title", "summary", "url", "date",
                          "score", "score_type"]


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(SQL) <= set(QUERIES) <= set(E.queries())
    # Vectors of a fitted encoder have no SQL form; see test_fitted.py.
    assert set(QUERIES) - set(SQL) == {"encode_documents_fitted", "vector_search_fitted"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    if not os.path.exists(SF_SMALL):
        pytest.skip("no test data")
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert canon(s_cols, s_rows) == canon(d_cols, d_rows)
