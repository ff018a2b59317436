"""Annotated HDF5 files, where h5py is installed: matrices as a partitioned read by ranges of rows.

Every task opens the file, which all executors must see, and reads the rows of one range with their names; the driver reads
names of genes and the shape only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .h5ad files needs h5py; convert them to a Parquet bundle elsewhere") from e
    return h5py


def _text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def _index(frame) -> str:
    """The column of a data frame that holds its names."""
    name = frame.attrs.get("_index", "_index")
    return name.decode() if isinstance(name, bytes) else name


def _column(node, at: slice = slice(None)) -> list[str | None]:
    """A column of obs or var: plain, or codes into categories."""
    if hasattr(node, "keys"):
        categories, codes = _text(node["categories"][:]), node["codes"][at]
        return [categories[c] if c >= 0 else None for c in codes]
    return _text(node[at])


def _matrix(f, matrix: str):
    """The node of a matrix and the frame that names its columns. ``auto``: raw counts if there are any; ``X``; or a path such
    as ``layers/counts``."""
    if matrix == "auto":
        matrix = "raw/X" if "raw/X" in f else "X"
    if matrix not in f:
        raise ValueError(f"there is no {matrix}")
    return f[matrix], f["raw/var"] if matrix == "raw/X" and "raw/var" in f else f["var"]


def _kind(node) -> str:
    if not hasattr(node, "keys"):
        return "dense"
    said = node.attrs.get("encoding-type", node.attrs.get("h5sparse_format", "csr"))
    return "csc" if "csc" in (said.decode() if isinstance(said, bytes) else str(said)) else "csr"


def _range(node, kind: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, column, value`` of what is not 0 in a range of rows, or, of a matrix kept by columns, of columns."""
    if kind == "dense":
        part = np.asarray(node[start:end], float)
        row, col = np.nonzero(part)
        return row + start, col, part[row, col]
    ptr = np.asarray(node["indptr"][start : end + 1])
    idx, val = np.asarray(node["indices"][ptr[0] : ptr[-1]]), np.asarray(node["data"][ptr[0] : ptr[-1]], float)
    major = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)) + start
    return (idx, major, val) if kind == "csc" else (major, idx, val)


def _starts(spark: SparkSession, n: int, chunk: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in range(0, n, chunk)] or [(0,)], "start long").repartition(max(1, -(-n // chunk)))


def read_names(spark: SparkSession, path: str, chunk: int = 50000, columns: tuple[str, ...] = ()) -> DataFrame:
    """``row, sample, ...``: the number and name of every cell, with columns of the observations as text."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        n = len(f["obs"][_index(f["obs"])])

    def run(batches):
        h5py = _h5py()
        for b in batches:
            for start in b.column("start").to_pylist():
                with h5py.File(path, "r") as f:
                    obs, at = f["obs"], slice(start, min(n, start + chunk))
                    names = _text(obs[_index(obs)][at])
                    own = [pa.array(_column(obs[c], at), pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(names))), pa.array(names, pa.string()), *own], ["row", "sample", *columns])

    return _starts(spark, n, chunk).mapInArrow(run, ", ".join(["row long", "sample string", *[f"`{c}` string" for c in columns]]))


def read_counts(spark: SparkSession, path: str, chunk: int = 50000, matrix: str = "auto", symbols: bool = True) -> DataFrame:
    """``gene, sample, value, pos``: what is not 0 of a matrix of cells by genes, dense or sparse by rows or columns.

    ``matrix`` is ``auto`` (raw counts, else X), ``X`` (as spatial data want) or a path in the file. Where most genes are named
    by Ensembl ids, ``symbols`` takes a column of symbols instead, if there is one.
    """
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        node, var = _matrix(f, matrix)
        kind, place = _kind(node), node.name.strip("/")
        genes = _text(var[_index(var)][:])
        found = next((c for c in ("gene_name", "feature_name", "gene_symbol", "symbol") if c in var), None)
        if symbols and found and sum(g.startswith(("ENSG", "ENSMUSG")) for g in genes) > 0.5 * len(genes):
            genes = [s or g for s, g in zip(_column(var[found]), genes, strict=True)]
        n = node.shape[0] if kind == "dense" else len(node["indptr"]) - 1
    sent = spark.sparkContext.broadcast(genes)  # a genome at most

    def run(batches):
        h5py, genes = _h5py(), np.array(sent.value, object)
        for b in batches:
            for start in b.column("start").to_pylist():
                with h5py.File(path, "r") as f:
                    row, col, val = _range(f[place], kind, start, min(n, start + chunk))
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(genes[col], pa.string()), pa.array(val), pa.array(col.astype(np.int64))], ["row", "gene", "value", "pos"])

    cells = _starts(spark, n, chunk).mapInArrow(run, "row long, gene string, value double, pos long")
    return cells.join(read_names(spark, path, chunk), "row").select("gene", "sample", "value", "pos")


def read_obs(spark: SparkSession, path: str, columns: list[str], chunk: int = 50000) -> DataFrame:
    """``sample`` and columns of the observations, as text."""
    return read_names(spark, path, chunk, tuple(columns)).drop("row").where(F.col("sample").isNotNull())


def read_embedding(spark: SparkSession, path: str, key: str, chunk: int = 50000) -> DataFrame:
    """``sample, vec`` of a matrix beside the observations: ``obsm/<key>``, or ``reductions/<key>/cell.embeddings``, which has
    cells in columns."""
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        turned = f"obsm/{key}" not in f
        place = f"reductions/{key}/cell.embeddings" if turned else f"obsm/{key}"
        if place not in f:
            raise ValueError(f"there is no {place}")
        n = f[place].shape[1 if turned else 0]

    def run(batches):
        h5py = _h5py()
        for b in batches:
            for start in b.column("start").to_pylist():
                with h5py.File(path, "r") as f:
                    end = min(n, start + chunk)
                    part = np.asarray(f[place][:, start:end].T if turned else f[place][start:end], float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.array(list(part), pa.list_(pa.float64()))], ["row", "vec"])

    rows = _starts(spark, n, chunk).mapInArrow(run, "row long, vec array<double>")
    return rows.join(read_names(spark, path, chunk), "row").select("sample", "vec")


def obs_columns(path: str) -> list[str]:
    with _h5py().File(path, "r") as f:
        return [c for c in f["obs"] if c != _index(f["obs"])]


def structure(path: str) -> list[str]:
    """A line for every node of the file: its path, and its shape and type, or what it holds."""
    out: list[str] = []

    def walk(node, name: str) -> None:
        if hasattr(node, "keys"):
            out.append(f"{name or '/'}: {', '.join(node.keys())}")
            for k in node.keys():  # noqa: SIM118 - a group, not a dict
                walk(node[k], f"{name}/{k}")
        else:
            out.append(f"{name}: {tuple(node.shape)} {node.dtype}")

    with _h5py().File(path, "r") as f:
        walk(f, "")
    return out


def write_results(results: DataFrame, path: str, annotated: bool = False) -> None:
    """A result table of driver size as one file: features by samples for each metric, with the names; or, ``annotated``, samples
    by features with beta as X and the others beside the observations. Larger ones are for ``sources.results``."""
    h5py = _h5py()
    rows = results.toArrow().to_pandas()
    if annotated:
        by = {m: rows.pivot(index="sample", columns="feature", values=m).sort_index().sort_index(axis=1) for m in ("beta", "se", "zscore", "pvalue")}
        with h5py.File(path, "w") as f:
            for frame, names in (("obs", by["beta"].index), ("var", by["beta"].columns)):
                f.create_group(frame).attrs["_index"] = "_index"
                f.create_dataset(f"{frame}/_index", data=np.array([str(v) for v in names], "S"))
            f.create_dataset("X", data=by["beta"].to_numpy())
            for m in ("se", "zscore", "pvalue"):
                f.create_dataset(f"obsm/{m}", data=by[m].to_numpy())
        return
    with h5py.File(path, "w") as f:
        for metric in ("beta", "se", "zscore", "pvalue"):
            wide = rows.pivot(index="feature", columns="sample", values=metric).sort_index()
            wide = wide[sorted(wide.columns, key=lambda c: (c.lower(), c))]
            f.create_dataset(metric, data=wide.to_numpy())
        f.attrs["feature_names"], f.attrs["sample_names"] = [str(v) for v in wide.index], [str(v) for v in wide.columns]
