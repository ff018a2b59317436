"""Queries without SQL cover their whole tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lumenact.operators import linalg, spatial, stats
from lumenact.plans import adapter, catalog

here = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no tables here")


def test_whole_signature_names_every_gene(spark, tmp_path):
    spark.range(1205).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.gene: r.weight for r in adapter.signature(spark, str(tmp_path), 1).collect()}
    assert got == {f"G{i:03d}": float(i) for i in range(1205)}


@here
def test_group_signatures_takes_all_genes_and_features(spark):
    got = {r.feature: r.members for r in catalog.QUERIES["group_signatures"](spark, oracle.FOLDER).collect()}
    x = np.stack([r.embedding for r in adapter.table(spark, oracle.FOLDER, "embeddings").orderBy("vec_id").collect()]).astype(float)
    _, names = linalg.group_features(x, [f"F{i:02d}" for i in range(x.shape[1])], 0.5)
    assert x.shape[1] == 64 and got == {n: n.count("|") + 1 for n in names}


@here
def test_signaling_patterns_has_every_significant_feature(spark):
    w = spatial.weights(adapter.spots(spark, oracle.FOLDER), catalog.RADIUS, catalog.SIGMA)
    act = adapter.expression(spark, oracle.FOLDER)
    near = spatial.neighbour_expression(act, w)
    r = spatial.neighbour_correlation(act.withColumnRenamed("gene", "feature"), near)
    want = {x.feature for x in r.where("p < 0.05").collect()}
    got = {x.feature for x in catalog.QUERIES["signaling_patterns"](spark, oracle.FOLDER).collect()}
    spark.catalog.clearCache()
    assert got == want and max(got) >= "G020"


def test_cox_ph_counts_copies_once_and_has_every_feature_of_cells(spark, tmp_path):
    r = np.random.default_rng(3)
    time, event, z = r.exponential(size=40) + 0.1, r.integers(0, 2, 40), r.normal(size=(40, 2, 2))  # donor, cell, feature
    rows = [(f, f"c{i}_{j}", i % 3, float(z[i, j, k])) for i in range(40) for j in range(2) for k, f in enumerate(["a", "b"])]
    rows += [row for row in rows if row[1].endswith("_0")] * 3 + [("bulk", "Diff", 9, 1.0)]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("activity", rows, "feature string, sample string, run_id long, zscore double")
    write("obs", [(f"c{i}_{j}", f"d{i}") for i in range(40) for j in range(2)], "sample string, donor string")
    write("panel", [("a", "core"), ("b", "ext"), ("bulk", "bulk")], "feature string, tier string")
    write("clinical", [(f"d{i}", float(time[i]), int(event[i]), i) for i in range(40)], "sample string, time double, event int, visited_at long")
    got = {x.feature: x.risk_score_z for x in catalog.QUERIES["cox_ph"](spark, str(tmp_path)).collect()}
    want = {f: stats._cox_fit(time, event, z[:, :, k : k + 1].mean(1)) for k, f in enumerate(["a", "b"])}
    assert set(got) == {"a", "b"}
    assert all(np.isclose(got[f], b / se, atol=1e-5) for f, (b, se) in want.items())
