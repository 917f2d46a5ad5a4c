"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

from verlog.plans import catalog, formats, replay

assert formats and replay  # register their queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = sorted(tuple(repr(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        q = con.sql(catalog.ORACLE_SQL[name])
        at = [q.columns.index(c) for c in sorted(q.columns)]
        assert sorted(q.columns) == sorted(df.columns)
        assert rows == sorted(tuple(repr(r[i]) for i in at) for r in q.fetchall())
    else:
        assert df.columns
