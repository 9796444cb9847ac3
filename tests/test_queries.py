"""Every registered query of the core against its SQL, or at least to its end."""

import os

import pytest

from casetide import plans

from .oracle import FOLDER, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() >= 0


def test_the_core_join_is_an_equi_join(spark):
    plan = plans.QUERIES["window_count_grid"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
