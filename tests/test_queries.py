import pytest
from tests.conftest import SF, rows_of

from tidemill.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*sorted(names)).collect()) == rows_of([tuple(r[names.index(n)] for n in sorted(names)) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_jvm(spark):
    """Filters reach the scan, only needed columns are read, and no Python runs in relational queries."""
    for name in QUERIES:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["l2_filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
