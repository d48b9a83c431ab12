"""Registered queries beside their SQL twins on the smallest tables.

The first query of every operator by default; all of them with TABSPARK_ALL_QUERIES=1 (about ten
minutes more), or by ``python tests/compare.py``.
"""

import os

import pytest
from compare import differences, make_duck

from tabspark import plans

SF = "/root/testdata/sf0.001"


def chosen() -> list[str]:
    names = list(plans.oracle_sql())
    if os.environ.get("TABSPARK_ALL_QUERIES"):
        return names
    first: dict[str, str] = {}
    for n in names:
        operator = n if n.startswith("stream_") else n.split("_")[0]
        first.setdefault(operator, n)
    return list(first.values())


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF)


@pytest.mark.parametrize("name", chosen())
def test_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(plans.oracle_sql()[name]).df()) == []


@pytest.mark.parametrize("name", ["m6_decision_tree_classifier", "v10_report", "flow_order_status", "stream_score"])
def test_runs_without_twin(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
