"""Every registered query against its SQL on the smallest tables, with a look at its plan."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from encore.plans.queries import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def test_flagship_query(spark):
    assert entry.entry(spark).count() == 10


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def staged_plans(monkeypatch):
    """Plans of the tables that a query writes on its way."""
    plans = []
    for module in [m for n, m in sys.modules.items() if n.startswith("encore") and hasattr(m, "staged")]:
        def record(table, label, write=module.staged):
            plans.append(plan_of(table))
            return write(table, label)
        monkeypatch.setattr(module, "staged", record)
    return plans


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, small, db, staged_plans, name):
    result = entry.queries()[name](spark, small)
    columns = sorted(result.columns)
    rows = result.select(columns).collect()
    for plan in [plan_of(result), *staged_plans]:
        assert not [bad for bad in FORBIDDEN if bad in plan]
    if name in entry.oracle_sql():
        relation = db.sql(entry.oracle_sql()[name])
        assert sorted(relation.columns) == columns
        want = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert canonical(rows) == canonical(want)
    else:
        assert rows
