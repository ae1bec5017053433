"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from compare import connect, differences, type_differences
from sondera.plans.files import FILES
from sondera.plans.files_oracle import FILES_SQL
from sondera.plans.oracle import ORACLE
from sondera.plans.queries import REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = REGISTRY | FILES, ORACLE | FILES_SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert operator not in plan
    assert type_differences(df, con, SQL[name]) == []
    assert differences(df, con, SQL[name]) == []
