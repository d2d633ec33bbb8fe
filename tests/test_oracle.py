"""Every core query that has SQL, against DuckDB on the same tables."""

import pytest

from runloom.plans import catalog
from tests import compare

pytestmark = pytest.mark.skipif(not compare.FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    compare.same(catalog.queries()[name](spark, str(compare.FOLDER)), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["command_check_features", "linear_shap", "vif_table", "variance_shares_glmm", "noise_ceiling", "fragments_prose", "vector_pca1"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, str(compare.FOLDER)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
