"""Every query with a SQL equivalent gives DuckDB's rows; the others give rows."""

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as contract

ORACLES = contract.oracle_sql()
# fitted models are covered by their own tests
SLOW = {
    "linear_regression", "ridge_regression", "lasso_regression", "boosted_regression", "forest_regression",
    "logistic_classification", "boosted_classification", "forest_classification", "model_predictions",
    "dbscan", "isolation_forest",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(contract.queries())
