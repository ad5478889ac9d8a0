"""Every query with SQL gives the same rows as that SQL at the smallest scale."""

import pytest

from tests.check import connect
from workload.compare import difference
from workload.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# These fit two 100-tree models; their parts are tested on small models in test_boosting.
SLOW = {"fit_outcome", "tree_shap_fitted"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_same_rows_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck.sql(ORACLES[name])) is None


@pytest.mark.parametrize("name", ["pca_by_state_all"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
