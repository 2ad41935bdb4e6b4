"""Every registered query against its DuckDB oracle on sf0.001 (the driver
checks sf0.01 the same way)."""

import os

import duckdb
import pytest

from tools.check_oracle import TABLES, canon
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    sql = oracle_sql().get(name)
    if sql is None:  # tested against brute force elsewhere
        assert rows and all(len(r) == len(df.columns) for r in rows)
        return
    r = con.execute(sql)
    assert canon(df.columns, rows) == canon([d[0] for d in r.description], r.fetchall())


def test_entry(spark):
    assert len(entry(spark).collect()) == 10
