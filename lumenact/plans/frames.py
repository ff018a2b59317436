"""The data behind the plots; drawing is left to any plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import quantiles
from ..operators.stats import fit_line


def distribution(by_radius: dict[str, DataFrame], feature: str) -> DataFrame:
    """``radius, label, sample, value``: one feature's values at every radius, in numeric order; radius 0 is ``Target``."""
    out = None
    for radius in sorted(by_radius, key=float):
        one = by_radius[radius].where(F.col("feature") == feature)
        one = one.select(F.lit(float(radius)).alias("radius"), F.lit("Target" if float(radius) == 0 else radius).alias("label"), "sample", "value")
        out = one if out is None else out.unionByName(one)
    return out


def boxes(values: DataFrame, labels: DataFrame) -> DataFrame:
    """``cell_type, n, least, q1, median, q3, most, place``: ``values(sample, value)`` by type, highest median first."""
    joined = values.where("value is not null and not isnan(value)").join(labels.where("cell_type is not null"), "sample")
    g = quantiles(joined, ["cell_type"], "value", {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0})
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("median").desc(), "cell_type")))


def gene_stats(expr: DataFrame, n_samples: int | None = None) -> DataFrame:
    """``gene, mean, detected``: mean over all samples (those that have rows unless their number is given) and the share of
    samples above 0."""
    n = expr.agg((F.lit(n_samples) if n_samples else F.count_distinct("sample")).alias("_n"))
    sums = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("c"))
    return sums.join(F.broadcast(n)).select("gene", (F.col("s") / F.col("_n")).alias("mean"), (F.col("c") / F.col("_n")).alias("detected"))


def type_counts(labels: DataFrame) -> DataFrame:
    """``cell_type, n``, most frequent first."""
    return labels.groupBy("cell_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "cell_type")


def top_and_bottom(values: DataFrame, name: str, value: str, n: int = 15) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest rows with ``side``; rows of a short table come twice."""
    high = values.orderBy(F.col(value).desc(), name).limit(n).withColumn("side", F.lit("high"))
    low = values.orderBy(F.col(value).asc(), name).limit(n).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def correlation(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return fit_line(pairs, by, x, y)


def most_variable(expr: DataFrame, n: int = 50) -> DataFrame:
    """``gene, variance`` (population variance over dense rows) of the ``n`` most variable genes."""
    return expr.groupBy("gene").agg(F.var_pop("value").alias("variance")).orderBy(F.col("variance").desc(), "gene").limit(n)


def heat_map(results: DataFrame, labels: DataFrame, metric: str = "zscore") -> DataFrame:
    """``feature, cell_type, value``: the mean by type."""
    return results.join(labels, "sample").groupBy("feature", "cell_type").agg(F.avg(metric).alias("value"))


def scatter(spots: DataFrame, values: DataFrame) -> DataFrame:
    """``sample, x, y, value`` of the spots that have a value."""
    return spots.join(values.select("sample", "value"), "sample").select("sample", "x", "y", "value")
