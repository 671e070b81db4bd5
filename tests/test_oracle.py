"""Every registered query against its SQL oracle (DuckDB) on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexigate.plans.catalog import QUERIES
from lexigate.sources.tables import TABLES
from tools.check_oracle import digest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    drows = res.fetchall()
    sh, scols = digest(df.columns, srows)
    dh, dcols = digest([d[0] for d in res.description], drows)
    assert scols == dcols
    assert len(srows) == len(drows)
    assert sh == dh


def test_every_query_has_oracle_or_is_streaming():
    missing = set(QUERIES) - set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert all(n.startswith("stream_") for n in missing), missing


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "type"]
    assert df.count() >= 0
