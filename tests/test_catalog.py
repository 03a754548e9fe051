"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest
from oracle import assert_same

from cladewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


def test_every_query_has_rows_or_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, SF).limit(1).columns


def test_trees_and_leaves_are_derived_once(spark):
    plan = catalog.QUERIES["ancestral_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "o_orderkey" not in plan
