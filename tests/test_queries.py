"""Every registered query against its SQL, on the smallest tables; the plans hold no nested-loop join."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_query_is_registered_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


PLANNED = """search_stem_widened search_batch suggest_names customer_lookup_cascade route_lists list_answers sections_by_number
order_lookup_batch order_item_lines active_promotions session_log chunk_table dq_state_audit""".split()


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_nested_loop(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
