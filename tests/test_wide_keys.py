"""Queries that render rows as members, over keys of many digits: no rendered line may lose its end at column 72."""

import duckdb
import pytest

from millrace.plans import catalog

NAMES = ["cobol_call_resolution", "cobol_sort_merge", "cobol_io_statements"]
TABLES = {"supplier": "s_suppkey", "customer": "c_custkey"}


@pytest.fixture(scope="module", params=[999_990, 9_000_000_000], ids=lambda n: f"{len(str(n))}-digits")
def wide(request, tmp_path_factory):
    """A folder of small tables whose keys begin at a number of so many digits, and DuckDB over it."""
    folder = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    for name, key in TABLES.items():
        con.execute(f"COPY (SELECT {request.param} + i AS {key}, 'x' AS note FROM range(24) AS t(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_over_wide_keys(spark, wide, name):
    folder, con = wide
    df = catalog.REGISTRY.queries()[name](spark, folder)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.REGISTRY.sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(expected, key=repr)
