"""Every registered query against its SQL in DuckDB, and rules its plan has to keep."""

import re

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.catalog import load

SF = "/root/testdata/sf0.001"
ALL, SQL = load().QUERIES, load().SQL  # the training-data queries have their tests beside their operators
BATCH = [n for n in ALL if not n.startswith("streaming_")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_sql(spark, con, name):
    df = ALL[name](spark, SF)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", BATCH)
def test_plan_rules(spark, name):
    plan = ALL[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                 "FlatMapGroupsInPandas"):
        assert node not in plan, node
    for schema in re.findall(r"ReadSchema: struct<([^>\n]*)", plan):
        if "l_orderkey" in schema or "l_shipdate" in schema:
            assert schema.count(":") < 8, f"reads most of lineitem: {schema}"


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(ALL) <= set(queries())
