"""Every registered corpus query; against SQL where there is some."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from compare import connect, differences, type_differences
from sondera.llm.queries import QUERIES
from sondera.llm.sql import SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NATIVE = ("op3_decontamination", "op4_line_frequency")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert type_differences(df, con, SQL[name]) == []
    assert differences(df, con, SQL[name]) == []


@pytest.mark.parametrize("name", NATIVE)
def test_native(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
