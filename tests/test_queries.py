"""Every named query against its SQL."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from nearfield.plans import registry
from tools.compare import TABLES, normal

SF = "/root/testdata/sf0.001"
registry.load_all()
NAMES = sorted(registry.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_only_approximate_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"latency_sketch"}


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    df = queries()[name](spark, SF)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, result.fetchall())


def test_flagship(spark):
    row = entry(spark).first()
    assert 0 < row.avg_recall <= 1 and row.k == 10
