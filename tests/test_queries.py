"""Every registered query against its SQL at the smallest scale."""

import importlib

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in SQL:
        assert difference(df.columns, rows, con, SQL[name]) is None


@pytest.mark.parametrize("name,table,module", [
    ("fda_match", "lineitem", "designations"), ("ema_match", "lineitem", "designations"), ("merge_designations", "lineitem", "designations"),
    ("summarise_chemicals", "lineitem", "associations"), ("corpus_rollup", "part", None), ("corpus_levels", "part", None),
])
def test_facts_are_read_once(spark, monkeypatch, name, table, module):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    if module:
        owner = importlib.import_module(f"umbel.operators.{module}")
        real = owner.materialize
        monkeypatch.setattr(owner, "materialize", lambda df, *a, **b: real(planned(df), *a, **b))
    planned(QUERIES[name](spark, SF))
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line and f"/{table}.parquet" in line]
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["confidence_final", "headline_counts"])
def test_the_artifact_stays_where_it_lies(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The left side of the join, down to its scan.
    left, scan = plan[plan.index("LeftOuter") :].split("FileScan", 1)
    assert "Exchange" not in left and "Bucketed: true" in scan.splitlines()[0]
