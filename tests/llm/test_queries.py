"""Registered queries whose result SQL expresses, against DuckDB."""

import duckdb
import pytest

from basketry.llm import queries as Q
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(Q.ORACLE_SQL[name])
    columns, rows = [c[0] for c in cur.description], cur.fetchall()
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, rows)[0]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
