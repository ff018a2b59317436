"""Delimited expression matrices, sniffed on the driver from a few lines and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def sniff_separator(lines: list[str]) -> str:
    """From the first three lines: tabs if they outnumber commas, commas if there are any, else white space."""
    tabs, commas = (sum(line.count(c) for line in lines[:3]) for c in "\t,")
    if tabs > commas:
        return "\t"
    return "," if commas else r"\s+"


def _number(x: str) -> bool:
    try:
        float(x)
        return True
    except ValueError:
        return False


def sniff_index(rows: list[list[str]]) -> int | None:
    """0 when the first column holds names, None when it holds numbers or there is no second column."""
    body = [r for r in rows if r]
    if not body or max(len(r) for r in body) < 2:
        return None
    return None if all(_number(r[0]) for r in body[1:] or body) else 0


def read_matrix(spark: SparkSession, path: str, sep: str | None = None, gene_col: str | None = None, header: bool = True) -> DataFrame:
    """A genes-by-samples file in long form: ``gene, sample, value, pos`` (``pos`` orders the genes as in the file).

    Plain or gzipped CSV, TSV or text in white space. A header may have one name fewer than the rows have fields. Cells
    that are no numbers are null; columns without any number are dropped; of rows with one gene the first is kept. One
    column of names and one of numbers is a single sample. An empty file gives no rows.
    """
    lines = [x for x in _head(spark, path, 5) if x.strip()]
    schema = "gene string, sample string, value double, pos long"
    if not lines:
        return spark.createDataFrame([], schema)
    sep = sep or sniff_separator(lines)
    split = lambda text: [p.strip().strip('"') for p in (text.split() if sep == r"\s+" else text.split(sep))]
    first, second = split(lines[0]), split(lines[1]) if len(lines) > 1 else []
    if header:
        names = first if not second or len(first) == len(second) else ["gene", *first]
    else:
        names = [f"V{i}" for i in range(len(first))]
    at = names.index(gene_col) if gene_col in names else 0
    # text lines keep quoted commas rare in expression files; positions come from the reader, not from a shuffle
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    if header:
        rows = rows.where(F.col("value") != lines[0])
    parts = F.split(F.trim("value") if sep == r"\s+" else F.col("value"), r"\s+" if sep == r"\s+" else ("\t" if sep == "\t" else f"\\Q{sep}\\E"))
    rows = rows.select("pos", F.transform(parts, lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', ""))).alias("p"))
    # one pass keeps the first row of a gene
    rows = rows.groupBy(F.get("p", F.lit(at)).alias("gene")).agg(F.min_by("p", "pos").alias("p"), F.min("pos").alias("pos"))
    samples = [(i, n) for i, n in enumerate(names) if i != at]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("sample"), F.get("p", F.lit(i)).try_cast("double").alias("value")) for i, n in samples]))
    long = rows.select("gene", "pos", cells.alias("c")).select("gene", "c.sample", "c.value", "pos")
    numeric = long.groupBy("sample").agg(F.count("value").alias("_n")).where("_n > 0").select("sample")
    return long.join(numeric, "sample", "left_semi").select("gene", "sample", "value", "pos")


def read_signature(spark: SparkSession, path: str) -> DataFrame:
    """``gene, feature, weight, pos`` of a tab-separated, possibly gzipped signature; missing weights are 0."""
    rows = read_matrix(spark, path, sep="\t")
    return rows.select("gene", F.col("sample").alias("feature"), F.coalesce("value", F.lit(0.0)).alias("weight"), "pos")


def read_pairs(spark: SparkSession, path: str, ligand: str = "Ligand.ApprovedSymbol", receptor: str = "Receptor.ApprovedSymbol") -> DataFrame:
    """``ligand, receptor`` from a tab-separated table."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(f"`{ligand}`").alias("ligand"), F.col(f"`{receptor}`").alias("receptor")).dropna().distinct()
