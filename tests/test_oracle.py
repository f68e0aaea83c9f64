"""Every query with an SQL twin gives DuckDB's rows on the same files."""

import math
import os

import duckdb
import pytest

from skylot import catalogue  # noqa: F401  registers the queries
from skylot.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(SF)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return "null" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
        return "null" if v is None else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted("|".join(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = duck.execute(SQL[name])
    assert sorted(d[0] for d in expected.description) == columns
    expected = duck.execute(f"SELECT {listed} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, rows.select(*(f"`{c}`" for c in columns)).collect())) == plain(expected)
