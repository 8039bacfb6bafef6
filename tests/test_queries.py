"""Every query of the core against its SQL on the smallest folder."""

import pytest
from oracle import assert_same, connect

from prepline import queries as core

Q, SQL = core.queries(), core.oracle_sql()
#: Trained dozens of times with the operators' defaults; their tests are in test_models.py.
SLOW = {"ebfs", "permutation_importance", "suggest_hyperparams"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert_same(Q[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL) - SLOW))
def test_runs(spark, small, name):
    assert Q[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
