"""Every registered query against its SQL twin on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from contrail.operators import cep
from contrail.plans.feed import Feed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    wanted = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(df.columns, df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith("stream_")))
def test_no_nested_loop_in_plan(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_both_spike_rules_share_one_window_exchange(spark):
    t = Feed(spark, SF)
    changes = cep.sample_changes(t.positions)
    plan = changes._jdf.queryExecution().executedPlan().toString()
    # one to drop repeated polls, one for both windows
    assert plan.count("Exchange hashpartitioning") == 2


def test_dimensions_are_broadcast_and_scans_pruned(spark):
    plan = queries()["flights_enriched"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "o_totalprice" not in plan


def test_entry(spark):
    assert entry(spark).count() > 0
