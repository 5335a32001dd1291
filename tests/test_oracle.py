"""Every catalogue query against its DuckDB oracle on the smallest scale
factor (the driver does the same at sf0.01)."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _queries():
    import __spark_entry__ as E
    return E.queries(), E.oracle_sql()


QS, SQL = _queries()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.mark.parametrize("name", sorted(QS))
def test_query_matches_oracle(spark, duck, name):
    df = QS[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows is not None
        return
    cur = duck.execute(SQL[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    order = sorted(df.columns)
    a = sorted((tuple(_norm(r[df.columns.index(c)]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[ocols.index(c)]) for c in order) for r in orows), key=repr)
    assert a == b
