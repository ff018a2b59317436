"""Every query of the subpackage over the smallest tables, against its SQL where there is one."""

import os

import pytest

import oracle
from lumenact.llm import queries

pytestmark = pytest.mark.skipif(not (os.path.isdir(oracle.FOLDER) and os.path.exists(queries.vocabulary_path())), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    oracle.agree(spark, duck, name, queries.QUERIES[name], queries.ORACLES.get(name))
    spark.catalog.clearCache()


FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chains(spark):
    """The first cell of the chain of every cell of the 0.01 tables, cells within 16 being linked."""
    from lumenact.llm import mixture, profiles

    cells = profiles.cell_profiles(spark, FOLDER)
    return {r["sample"]: r["first"] for r in mixture.linked(cells, queries.NEAR).collect()}


def test_the_subset_covers_every_kind(spark, chains):
    got = [r["sample"] for r in queries.p1_subset(spark, FOLDER).collect()]
    assert len(got) <= queries.SUBSET_SIZE and {chains[s] for s in got} == set(chains.values())


def test_clusters_are_pure_and_whole(spark, chains):
    from lumenact.llm import mixture, profiles

    cells = profiles.cell_profiles(spark, FOLDER)
    own = mixture.memberships(cells, mixture.fit(cells)).select("sample", "cluster", "annotation").toPandas()
    own["kind"] = own["sample"].map(chains)
    most = own.groupby("cluster")["kind"].agg(lambda k: k.value_counts().iloc[0]).sum()
    assert len(own) == len(chains) and most >= 0.97 * len(own)
    got = queries.p3_clusters(spark, FOLDER).toPandas()
    assert got["size"].sum() == len(chains) and (got["annotation_size"].fillna(0) <= got["size"]).all()
