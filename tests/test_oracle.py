"""Registered queries against DuckDB on the smallest tables, and the shape of their plans."""

import re
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
#: Tests of the corpus queries are in a folder of their own.
OWN = re.compile(r"op\d+_|pipeline$")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(name for name in oracle_sql() if not OWN.match(name)))
def test_same_rows_as_sql(spark, duck, name):
    assert difference(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", ["server_impact", "governance_gaps", "people_of_process", "node_degrees", "review_items", "org_resolution"])
def test_plans_hold_no_product(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct", plan)


@pytest.mark.parametrize("name,scans", [("edge_conformance", 40), ("ownerless_counts", 11), ("entity_validation", 3)])
def test_plans_join_by_equality(spark, name, scans):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)
    assert plan.count("FileScan") <= scans
