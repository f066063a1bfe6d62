"""Shape of the physical plans of all registered queries and of the tables they store on the way."""

import re

import pytest
from plans import check_plan, stored_plans_checked

from habitatq.catalog import queries as catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_plan(spark, name):
    with stored_plans_checked(python=False):
        check_plan(catalog.as_callables()[name](spark, FOLDER), python=False)


def test_only_needed_columns_and_filters_reach_the_scan(spark):
    plan = catalog.as_callables()["scan_depth_grid"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*ThanOrEqual\(lon", plan)
    plan = catalog.as_callables()["effort_proportions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "o_orderdate" not in plan
