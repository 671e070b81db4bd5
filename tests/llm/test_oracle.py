"""Operator queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lexigate.llm.queries import QUERIES
from lexigate.sources.tables import TABLES
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    fn, sql = QUERIES[name]
    df = fn(spark, SF)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, found.fetchall())
