"""Command line: ``python -m lumenact.cli bulk|scrnaseq|visium|cosmx|compare|convert|inspect``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, prep
from .plans import pipelines
from .sources import h5ad, results, tenx
from .sources.delimited import read_matrix
from .sources.signatures import Catalogue

#: Columns that may hold cell types, the first one there is (fixed values).
TYPE_COLUMNS = ("cell_type", "celltype", "Annotation", "annotation", "cluster", "leiden", "louvain")


def _expression(spark: SparkSession, path: str, transpose: bool = False, matrix: str = "auto") -> DataFrame:
    """``gene, sample, value[, pos]`` of a delimited file, a Parquet directory, a bundle, a folder of counts or an .h5ad file."""
    if path.endswith(".h5ad"):
        rows = h5ad.read_counts(spark, path, matrix=matrix)
    elif os.path.exists(f"{path}/matrix.mtx.gz"):
        rows = tenx.read_folder(spark, path)["counts"]
    elif os.path.isdir(f"{path}/counts"):
        rows = spark.read.parquet(f"{path}/counts")
    elif results.format_of(path) == "parquet" and not path.endswith((".txt", ".tsv", ".gz", ".tab")):
        rows = spark.read.parquet(path)
    else:
        rows = read_matrix(spark, path)
    if transpose:
        return rows.select(F.col("sample").alias("gene"), F.col("gene").alias("sample"), "value")
    return rows.select("gene", "sample", "value", *[c for c in ("pos",) if c in rows.columns])


def _types(spark: SparkSession, path: str, column: str | None, required: bool) -> DataFrame | None:
    """``sample, cell_type``: a column of the observations of an .h5ad file or a bundle, or a table of its own."""
    if path.endswith(".h5ad"):
        own = h5ad.obs_columns(path)
    elif os.path.isdir(f"{path}/obs"):
        own = spark.read.parquet(f"{path}/obs").columns
    else:
        own = []
    found = column if column in own else prep.find_column(own, list(TYPE_COLUMNS)) if column is None else None
    if found is None:
        if column and os.path.exists(column):
            return spark.read.csv(column, header=True, sep="\t").select("sample", "cell_type")
        if required or column:
            raise SystemExit(f"no column of cell types{f' {column}' if column else ''} in {path}; it has {', '.join(own) or 'none'}")
        return None
    obs = h5ad.read_obs(spark, path, [found]) if path.endswith(".h5ad") else spark.read.parquet(f"{path}/obs")
    return obs.select("sample", F.col(f"`{found}`").cast("string").alias("cell_type"))


def _options(a: argparse.Namespace) -> dict:
    return {
        "lam": a.lam, "n_rand": a.n_rand, "seed": a.seed, "batch_size": a.batch_size or 512, "rng_method": a.rng, "sig_filter": a.sig_filter,
        "grouping": a.group, "order": "sorted" if a.sort_genes else "expression", "backend": a.backend,
    }


def _save(a: argparse.Namespace, out: DataFrame) -> int:
    results.save(out.orderBy("feature") if a.sort_output else out, a.output, mode="overwrite")
    if a.verbose and not a.quiet:
        shape = results.load(out.sparkSession, a.output).agg(F.countDistinct("feature"), F.countDistinct("sample")).first()
        print(f"{shape[0]} features of {shape[1]} samples in {a.output}")
    return 0


def cmd_bulk(spark, a) -> int:
    control = _expression(spark, a.control) if a.control else None
    return _save(a, pipelines.bulk(_expression(spark, a.input, a.transpose), Catalogue(spark).load(a.signature), control, is_differential=a.differential, **_options(a)))


def cmd_scrnaseq(spark, a) -> int:
    obs = None if a.single_cell else _types(spark, a.input, a.cell_type_col, required=True)
    return _save(a, pipelines.single_cell(_expression(spark, a.input), Catalogue(spark).load(a.signature), obs, per_cell=a.single_cell, **_options(a)))


def _spatial(spark, a, counts: DataFrame) -> int:
    control = _expression(spark, a.control, matrix="X") if a.control else None
    by_type = a.cell_type_col is not None and not a.spot_level
    obs = _types(spark, a.input, a.cell_type_col, required=True) if by_type else None
    return _save(a, pipelines.spatial(counts, Catalogue(spark).load(a.signature), obs, by_type=by_type, scale_factor=a.scale_factor, least_genes=a.min_genes, control=control, **_options(a)))


def cmd_visium(spark, a) -> int:
    folder = os.path.exists(f"{a.input}/matrix.mtx.gz")
    return _spatial(spark, a, tenx.read_folder(spark, a.input, positions=a.positions)["counts"] if folder else _expression(spark, a.input, matrix="X"))


def cmd_cosmx(spark, a) -> int:
    return _spatial(spark, a, _expression(spark, a.input, matrix="X"))


def cmd_compare(spark, a) -> int:
    """0 when every metric of the pairs both have differs by no more than the tolerance. Without ``--sort`` both tables must
    have the same features and samples."""
    left, right = results.load(spark, a.file1), results.load(spark, a.file2)
    good = True
    only = [(c, compare.missing(x, y, c).count(), name) for c in ("feature", "sample") for x, y, name in ((left, right, a.file1), (right, left, a.file2))]
    for column, n, name in only:
        if n:
            print(f"{n} {column}s only in {name}")
            good &= a.sort or (a.by_position and column == "sample")
    for metric in a.metrics:
        try:
            row = (compare.positional if a.by_position else compare.compare)(left, right, metric, a.tolerance).first()
        except ValueError as e:
            print(metric, e)
            return 1
        good &= bool(row["within"])
        print(metric, *[f"{k}={row[k]}" for k in ("n", "max_abs", "mean_abs", "rmse", "r", "at_feature", "at_sample", "within")])
    print("identical within the tolerance" if good else "different")
    return 0 if good else 1


def cmd_convert(spark, a) -> int:
    """A matrix file or a result table as long rows, or the other way round, by the suffix of the output. A matrix with fewer
    than 2,000 rows and more than 10,000 columns has features in rows and is turned."""
    if a.input.endswith(".h5ad") or results.format_of(a.input) == "parquet" and a.input.endswith((".txt", ".tsv", ".gz", ".tab")):
        rows = _expression(spark, a.input)
        shape = rows.agg(F.countDistinct("gene").alias("genes"), F.countDistinct("sample").alias("samples")).first()
        turned = a.transpose or (shape["samples"] < 2000 and shape["genes"] > 10000)
        rows = rows.select(F.col("sample" if turned else "gene").alias("feature"), F.col("gene" if turned else "sample").alias("sample"), F.col("value").alias("beta"))
        if a.verbose:
            print(f"{shape['genes']} x {shape['samples']}{', turned' if turned else ''}")
    else:
        rows = results.load(spark, a.input)
    results.save(rows, a.output, mode="overwrite")
    return 0


def cmd_inspect(spark, a) -> int:
    if a.input.endswith(".h5ad"):
        for line in h5ad.structure(a.input):
            print(line)
        return 0
    results.info(spark, a.input).show(truncate=False)
    compare.summary(results.load(spark, a.input)).show(truncate=False)
    if a.verbose:
        results.load(spark, a.input).show(5, truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenact")
    sub = p.add_subparsers(dest="command", required=True)

    def inference(name: str, fn, **more) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.set_defaults(run=fn)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-o", "--output", required=True)
        s.add_argument("-s", "--signature", required=True, help="a path, since no signature comes with this package")
        s.add_argument("--lambda", dest="lam", type=float, default=5e5)
        s.add_argument("-n", "--n-rand", type=int, default=1000)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--backend", choices=pipelines.BACKENDS, default="auto")
        s.add_argument("--batch-size", type=int, default=None)
        s.add_argument("--use-cache", action="store_true", help="permutation tables are always kept for the session")
        s.add_argument("--sort-genes", action="store_true")
        s.add_argument("--sort-output", action="store_true")
        s.add_argument("-v", "--verbose", action="store_true")
        s.add_argument("-q", "--quiet", action="store_true")
        s.add_argument("--rng", choices=("srand", "gsl", "numpy"), default=None)
        s.add_argument("--sig-filter", action=argparse.BooleanOptionalAction, default=more.get("sig_filter", False))
        s.add_argument("--group", action=argparse.BooleanOptionalAction, default=True)
        return s

    bulk = inference("bulk", cmd_bulk)
    bulk.add_argument("-c", "--control")
    bulk.add_argument("-d", "--differential", action="store_true")
    bulk.add_argument("--transpose", action="store_true")
    cells = inference("scrnaseq", cmd_scrnaseq)
    cells.add_argument("-c", "--cell-type-col", help="a column of the observations, or a table of sample and cell_type")
    cells.add_argument("--single-cell", action="store_true")
    for name, fn, least, scale, only in (("visium", cmd_visium, 200, 1e5, False), ("cosmx", cmd_cosmx, 50, 1000.0, True)):
        s = inference(name, fn, sig_filter=only)
        s.add_argument("-c", "--cell-type-col")
        s.add_argument("--spot-level", action=argparse.BooleanOptionalAction, default=True)
        s.add_argument("--control")
        s.add_argument("--min-genes", type=int, default=least)
        s.add_argument("--scale-factor", type=float, default=scale)
        if name == "visium":
            s.add_argument("--positions")
    c = sub.add_parser("compare")
    c.set_defaults(run=cmd_compare)
    c.add_argument("file1")
    c.add_argument("file2")
    c.add_argument("-t", "--tolerance", type=float, default=1e-10)
    c.add_argument("--sort", action="store_true", help="only what both have")
    c.add_argument("--by-position", action="store_true", help="samples by their place, features by name")
    c.add_argument("-v", "--verbose", action="store_true")
    c.add_argument("--metrics", nargs="+", default=list(compare.METRICS))
    for name, fn in (("convert", cmd_convert), ("inspect", cmd_inspect)):
        s = sub.add_parser(name)
        s.set_defaults(run=fn)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-v", "--verbose", action="store_true")
        if name == "convert":
            s.add_argument("-o", "--output", required=True)
            s.add_argument("--transpose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenact").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
