"""Annotated files in every layout, through a stand-in for h5py."""

import importlib.util
import os
import sys

import numpy as np
import pytest

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fakes")


@pytest.fixture(scope="module")
def h5(spark):
    if importlib.util.find_spec("h5py"):
        import h5py

        return h5py
    spark.sparkContext.addPyFile(os.path.join(HERE, "h5py.py"))
    sys.path.insert(0, HERE)
    import h5py

    yield h5py
    sys.path.remove(HERE)
    sys.modules.pop("h5py", None)


def sparse(f, path, m, kind):
    major = m if kind == "csr" else m.T
    g = f.create_group(path)
    g.attrs["encoding-type"] = f"{kind}_matrix"
    rows = [np.flatnonzero(r) for r in major]
    f.create_dataset(f"{path}/indptr", data=np.append(0, np.cumsum([len(r) for r in rows])))
    f.create_dataset(f"{path}/indices", data=np.concatenate(rows))
    f.create_dataset(f"{path}/data", data=np.concatenate([r[i] for r, i in zip(major, rows, strict=True)]))


@pytest.fixture(scope="module")
def file(h5, tmp_path_factory):
    r = np.random.default_rng(0)
    raw, x = (np.where(r.random((11, 7)) < 0.5, 0.0, r.integers(1, 9, (11, 7))) for _ in range(2))
    path = str(tmp_path_factory.mktemp("h5") / "a.h5ad")
    with h5.File(path, "w") as f:
        for frame in ("obs", "var", "raw/var"):
            f.create_group(frame).attrs["_index"] = "names"
        f.create_dataset("obs/names", data=np.array([f"c{i:02d}" for i in range(11)], "S"))
        f.create_dataset("obs/CellType/categories", data=np.array(["T", "B"], "S"))
        f.create_dataset("obs/CellType/codes", data=np.array([0, 1, -1, 0, 1, 0, 0, 1, 1, 0, -1]))
        f.create_dataset("obs/batch", data=np.array(["x"] * 11, "S"))
        for v in ("var", "raw/var"):
            f.create_dataset(f"{v}/names", data=np.array([f"ENSG{i:03d}" for i in range(7)], "S"))
        f.create_dataset("var/symbol", data=np.array([f"g{i}" for i in range(7)], "S"))
        f.create_dataset("X", data=x)
        sparse(f, "raw/X", raw, "csr")
        sparse(f, "layers/byc", raw, "csc")
        f.create_dataset("obsm/pca", data=raw[:, :2])
        f.create_dataset("reductions/umap/cell.embeddings", data=x[:, :3].T)
    return path, raw, x


def dense(df, genes):
    out = np.zeros((11, 7))
    for r in df.collect():
        assert genes[r.pos] == r.gene
        out[int(r["sample"][1:]), r.pos] = r.value
    return out


@pytest.mark.parametrize("chunk", [3, 50])
def test_matrices(spark, h5, file, chunk):
    from lumenact.sources import h5ad

    path, raw, x = file
    ids, symbols = [f"ENSG{i:03d}" for i in range(7)], [f"g{i}" for i in range(7)]
    assert (dense(h5ad.read_counts(spark, path, chunk), ids) == raw).all()  # raw counts have no symbols here
    assert (dense(h5ad.read_counts(spark, path, chunk, "X"), symbols) == x).all()
    assert (dense(h5ad.read_counts(spark, path, chunk, "layers/byc"), symbols) == raw).all()
    assert (dense(h5ad.read_counts(spark, path, chunk, "X", symbols=False), ids) == x).all()
    with pytest.raises(ValueError):
        h5ad.read_counts(spark, path, matrix="layers/none")
    for key, want in (("pca", raw[:, :2]), ("umap", x[:, :3])):
        got = {r["sample"]: list(r.vec) for r in h5ad.read_embedding(spark, path, key, chunk).collect()}
        assert got == {f"c{i:02d}": w.tolist() for i, w in enumerate(want)}
    obs = {r["sample"]: (r.CellType, r.batch) for r in h5ad.read_obs(spark, path, ["CellType", "batch"], chunk).collect()}
    assert len(obs) == 11 and obs["c00"] == ("T", "x") and obs["c02"] == (None, "x")
    assert h5ad.obs_columns(path) == ["CellType", "batch"]
    assert "/X: (11, 7) float64" in h5ad.structure(path)


def test_results_and_command_line(spark, h5, file, tmp_path):
    from lumenact.cli import main
    from lumenact.sources import h5ad

    path, raw, x = file
    rows = [(f, s, 1.0 * i, 2.0, 3.0, 0.5) for i, f in enumerate("ba") for s in ("s2", "S1")]
    h5ad.write_results(spark.createDataFrame(rows, "feature string, sample string, beta double, se double, zscore double, pvalue double"), str(tmp_path / "r.h5"))
    with h5.File(str(tmp_path / "r.h5"), "r") as f:
        assert list(f.attrs["feature_names"]) == ["a", "b"] and list(f.attrs["sample_names"]) == ["S1", "s2"] and f["beta"][:].tolist() == [[1, 1], [0, 0]]
    act = spark.createDataFrame(rows, "feature string, sample string, beta double, se double, zscore double, pvalue double")
    h5ad.write_results(act, str(tmp_path / "r.h5ad"), annotated=True)
    back = {(r["sample"], r.gene): r.value for r in h5ad.read_counts(spark, str(tmp_path / "r.h5ad")).collect()}
    assert back == {("S1", "a"): 1.0, ("s2", "a"): 1.0}  # zeros have no rows
    assert {tuple(r.vec) for r in h5ad.read_embedding(spark, str(tmp_path / "r.h5ad"), "zscore").collect()} == {(3.0, 3.0)}
    assert main(["inspect", "-i", path]) == 0
    (tmp_path / "s.tsv").write_text("gene\tf1\tf2\n" + "".join(f"ENSG{i:03d}\t{i % 3}\t{(i * 5) % 7}\n" for i in range(7)))
    out = str(tmp_path / "o.parquet")
    assert main(["scrnaseq", "-i", path, "-s", str(tmp_path / "s.tsv"), "-n", "3", "--lambda", "1", "-o", out]) == 0
    assert {r["sample"] for r in spark.read.parquet(out).collect()} == {"T", "B"}
    assert main(["convert", "-i", path, "-o", str(tmp_path / "c.parquet"), "-v"]) == 0
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == (raw > 0).sum()
