"""Result tables and bundles on storage: Parquet, one directory a table, always read lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import METRICS, by_sample, wide

FORMATS = ("parquet", "csv", "json", "orc")
#: Samples that become columns at most.
MANY = 2000


def format_of(path: str, format: str = "auto") -> str:  # noqa: A002
    """By suffix; Parquet where it says nothing."""
    if format != "auto":
        if format not in FORMATS:
            raise ValueError(f"format is one of {', '.join(FORMATS)}")
        return format
    tail = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return tail if tail in FORMATS else "parquet"


def save(results: DataFrame, path: str, format: str = "auto", compression: str = "zstd", mode: str = "errorifexists") -> None:  # noqa: A002
    """The long table as one directory; every task writes its own part, so nothing is gathered."""
    kind = format_of(path, format)
    writer = results.write.mode(mode)
    if kind in ("parquet", "orc"):
        writer = writer.option("compression", compression)
    getattr(writer, kind)(path, **({"header": True} if kind == "csv" else {}))


def save_matrices(results: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:  # noqa: A002
    """A features-by-samples directory for each metric, ``<path>_<metric>``; with more than ``MANY`` samples one of samples by
    features, since samples grow with the data and features do not."""
    many = results.select("sample").distinct().limit(MANY + 1).count() > MANY
    for metric in METRICS:
        save(by_sample(results, metric) if many else wide(results, metric), f"{path}_{metric}", format, "snappy", mode)


def load(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:  # noqa: A002
    kind = format_of(path, format)
    if kind == "csv":
        return spark.read.csv(path, header=True, schema="feature string, sample string, beta double, se double, zscore double, pvalue double")
    return getattr(spark.read, kind)(path)


def append_batch(results: DataFrame, path: str) -> None:
    """Results of more samples beside those already written."""
    results.write.mode("append").option("compression", "zstd").parquet(path)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, columns with types, rows, features and samples."""
    df = load(spark, path)
    shape = df.agg(F.count("*").alias("rows"), F.countDistinct("feature").alias("features"), F.countDistinct("sample").alias("samples"))
    columns = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return shape.select(F.lit(len(df.inputFiles())).alias("files"), F.lit(columns).alias("columns"), "rows", "features", "samples")


def save_bundle(path: str, mode: str = "errorifexists", **tables: DataFrame) -> None:
    """Several tables of one data set (counts, obs, var, spots, activity) under one directory."""
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
