"""Recall of the search for similar vectors where few lists are asked: half a million rows, some minutes. LUMENACT_LARGE=1 runs it."""

import os

import numpy as np
import pyarrow as pa
import pytest

from lumenact.llm import similar
from lumenact.llm.common import lists

pytestmark = pytest.mark.skipif(os.environ.get("LUMENACT_LARGE") != "1", reason="LUMENACT_LARGE=1 runs it")

ROWS, DIM, KINDS, K, ASKED = 500_000, 32, 2_000, 10, 500


def test_recall_of_half_a_million(spark, tmp_path):
    kinds, dim = KINDS, DIM  # the workers do not know this module

    def rows(numbers: np.ndarray) -> np.ndarray:
        """Rows around kinds of very different sizes, in all scales."""
        centres = np.random.default_rng(1).normal(size=(kinds, dim)) * 2
        out = []
        for block in np.unique(numbers // 1000):
            r = np.random.default_rng(int(block) + 7)
            kind = (kinds * r.random(1000) ** 2).astype(int)
            x = (centres[kind] + r.normal(size=(1000, dim))) * r.lognormal(size=(1000, 1))
            out.append(x[numbers[numbers // 1000 == block] % 1000])
        return np.vstack(out)

    def made(batches):
        for b in batches:
            n = b.column("id").to_numpy()
            for at in range(0, len(n), 1000):
                part = n[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([f"v{i:07d}" for i in part]), lists(rows(part))], ["sample", "vec"])

    spark.range(0, ROWS, 1, 50).mapInArrow(made, "sample string, vec array<double>").write.parquet(str(tmp_path / "v"))
    points = spark.read.parquet(str(tmp_path / "v"))
    index = similar.build(points)
    own = similar.members(points, index).persist()
    probes = similar.probes_for(own, index, K, 0.97)
    own.unpersist()
    total = np.prod([len(c) for c in index.levels])
    got = similar.nearest(points, K, probes=probes).toPandas()
    assert got.groupby("sample").size().eq(K).all() and got["sample"].nunique() == ROWS
    numbers = np.arange(0, ROWS, ROWS // ASKED)
    every = similar.unit(rows(np.arange(ROWS))).astype(np.float32)
    q = every[numbers]
    score = q @ every.T
    score[np.arange(len(q)), numbers] = -9
    true = np.argpartition(-score, K, axis=1)[:, :K]
    mine = got[got["sample"].isin([f"v{i:07d}" for i in numbers])].groupby("sample")["other"].agg(set)
    recall = np.mean([f"v{j:07d}" in mine[f"v{i:07d}"] for i, row in zip(numbers, true, strict=True) for j in row])
    print(f"{ROWS} rows, {total} lists, {probes} asked ({probes / total:.1%}), recall {recall:.3f}")
    assert probes / total < 0.1 and recall >= 0.9
