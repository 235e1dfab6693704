"""Every registered query with a SQL oracle equals DuckDB on the same parquet
tables (row count, column names, order-insensitive hash of rounded values)."""

import os

import duckdb
import pytest

from sf_dirs import SF001
from tools.oracle_check import digest

import __spark_entry__ as entry
from basketry.sources.tables import TABLES

SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_a_builder():
    assert set(SQLS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(SQLS[name])
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(scols, srows)[0] == digest(dcols, drows)[0]
