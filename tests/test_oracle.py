"""Every registered query gives the rows its SQL gives on DuckDB, by a plan without joins of all with all."""

from __future__ import annotations

import re

import pytest
from check import connect, rows_of

import __spark_entry__ as entry
from featmill import workload

QUERIES, SQL = workload.QUERIES, workload.SQL
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for feeding in re.findall(r"Exchange SinglePartition.*?\n((?:.*\n){3})", plan):
        # Only totals, and offsets of whole range partitions, may meet in one task.
        assert "HashAggregate" in feeding or "_p_rows" in feeding or "_rows" in feeding or "_part" in feeding, feeding


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    check_plan(df)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(t) for c, t in df.dtypes} == kinds
    assert rows_of(df.columns, got) == rows_of(names, result.fetchall())
    # The smallest tables have too few shards per source for a test split.
    assert got or name == "nonempty_split"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 40
    assert df.columns == ["label", "channel", "n", "mean", "std"]
