"""Every catalogue query against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
SQL = catalog.REGISTRY.sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.REGISTRY.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = shown(df.select(*columns).collect())
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert found == shown(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())
