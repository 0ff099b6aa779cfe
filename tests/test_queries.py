"""Every query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from terrace import queries

TABLES = ["lineitem", "orders", "part"]
#: Slow to compare and alike others in what they run.


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda t: sorted(map(tuple, t[columns].astype(object).values.tolist()), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b or all(x == y or all(p == q or abs(p - q) <= 1e-9 * max(abs(p), 1) for p, q in zip(x, y)) for x, y in zip(a, b))
