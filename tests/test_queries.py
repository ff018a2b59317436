"""Every query of the engine against its SQL over the smallest tables."""

import os

import pytest

import oracle
from lumenact.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    oracle.agree(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["feature", "sample", "beta", "se", "zscore", "pvalue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
