"""Folders of spatial or single-cell counts in matrix-market form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep


def _numbered(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines with their number from 1. The files name genes or barcodes and are small; one task reads a gzipped file."""
    rows = spark.read.text(path).coalesce(1).withColumn("_id", F.monotonically_increasing_id())
    return rows.select((F.col("_id") + 1).cast("int").alias("n"), F.split("value", sep).alias("p"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, value`` (from 1) of a coordinate matrix, plain or gzipped; comments and the size line are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.limit(1).collect()
    p = F.split(F.trim("value"), r"\s+")
    cells = lines.where(F.col("value") != size[0]["value"]) if size else lines
    return cells.select(p[0].cast("int").alias("row"), p[1].cast("int").alias("col"), p[2].cast("double").alias("value"))


def read_folder(spark: SparkSession, path: str, min_genes: int = 0, positions: str | None = None, scale_factors: str | None = None) -> dict[str, DataFrame | dict]:
    """``counts(gene, sample, value)``, ``spots(sample, barcode, array_row, array_col, x, y)`` and ``scale_factors``.

    Symbols are the second column of ``features.tsv.gz``. With positions only spots in tissue stay and are named
    ``row x col`` (``12x7``); a header in the positions file is recognised. Spots with fewer than ``min_genes`` genes go.
    """
    genes = _numbered(spark, f"{path}/features.tsv.gz").select(F.col("n").alias("row"), F.coalesce(F.get("p", F.lit(1)), F.get("p", F.lit(0))).alias("gene"))
    codes = _numbered(spark, f"{path}/barcodes.tsv.gz").select(F.col("n").alias("col"), F.get("p", F.lit(0)).alias("barcode"))
    cells = read_matrix_market(spark, f"{path}/matrix.mtx.gz")
    if positions:
        raw = spark.read.csv(positions, header=False).toDF("barcode", "in_tissue", "array_row", "array_col", "x", "y")
        placed = raw.where(F.expr("try_cast(in_tissue as int) = 1"))
        spots = codes.join(placed, "barcode").select(
            F.concat_ws("x", F.expr("cast(array_row as int)"), F.expr("cast(array_col as int)")).alias("sample"), "barcode", "col",
            *[F.col(c).cast("int") for c in ("array_row", "array_col")], *[F.col(c).cast("double") for c in ("x", "y")],
        )
    else:
        spots = codes.withColumn("sample", F.col("barcode"))
    counts = cells.join(genes, "row").join(spots.select("col", "sample"), "col").select("gene", "sample", "value")
    if min_genes:
        counts = prep.min_genes(counts, min_genes)
        spots = spots.join(counts.select("sample").distinct(), "sample", "left_semi")
    factors = {"tissue_lowres_scalef": 1.0}
    if scale_factors:
        text = spark.read.text(scale_factors, wholetext=True).first()
        factors |= json.loads(text["value"]) if text else {}
    return {"counts": counts, "spots": spots.drop("col"), "scale_factors": factors}
