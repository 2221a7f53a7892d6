"""Every query of the catalogue with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.queries import CATALOGUE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


def shown(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    query, sql = CATALOGUE[name]
    df = query(spark, SF)
    rows = df.collect()
    if sql:
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert table(rows, df.columns) == table(found.fetchall(), names)
