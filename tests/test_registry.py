"""Every query against its SQL, over whole tables of the smallest scale where they are there."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, float):
            return round(x, 6)
        if hasattr(x, "isoformat"):
            return str(x)[:19]
        return int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) else x

    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def names():
    from lodegraph.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from lodegraph.plans import registry

    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0 and got.columns  # rows there must be; what they hold is tested on small inputs elsewhere
        return
    a, b = got.toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_plans_prune_columns(spark):
    from lodegraph.plans import registry

    plan = registry.queries()["god_nodes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PushedFilters" in plan
    for name in ("keyword_search", "hybrid_search"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any("content" in x for x in plan.split("\n") if "Exchange" in x)
    plan = registry.queries()["keyword_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "In(term" in plan  # postings alone, the query's terms pushed to the scan
