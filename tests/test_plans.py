"""Scale guards on the physical plans of every batch query."""

import pytest

import __spark_entry__ as entry
from lexigate.plans.catalog import QUERIES

from conftest import SF_SMALL

GLOBAL_AGGREGATES = {"pattern_count"}  # one row out; partial counts are combined first


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_single_partition_or_cartesian(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "InPandas" not in plan and "PythonUDTF" not in plan
    if name not in GLOBAL_AGGREGATES:
        assert "SinglePartition" not in plan


def test_document_scan_is_pruned(spark):
    df = entry.queries()["url_verdict"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "n_chars" not in plan and "source" not in plan
