"""Every registered query against its SQL twin; those without one must run."""

import os

import pytest

from lumenframe.plans import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_pushdown_and_no_nested_loops(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan("tail_fraction") or "ReadSchema: struct<event_type:string,value:double>" in plan("tail_fraction")
    for name in ("pick_many_circles", "nena_histogram", "neighbour_counts", "aim_shift_counts", "roi_traces"):
        assert "NestedLoop" not in plan(name) and "CartesianProduct" not in plan(name), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
