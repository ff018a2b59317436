"""Comparing, joining and shaping result tables ``feature, sample, beta, se, zscore, pvalue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("beta", "se", "zscore", "pvalue")


def compare(a: DataFrame, b: DataFrame, metric: str = "zscore", tolerance: float = 1e-10) -> DataFrame:
    """One row over the pairs both have: ``n, max_abs, mean_abs, rmse, r, at_feature, at_sample, within``."""
    left = a.select("feature", "sample", F.col(metric).alias("va"))
    right = b.select("feature", "sample", F.col(metric).alias("vb"))
    d = left.join(right, ["feature", "sample"]).where("va is not null and vb is not null").withColumn("d", F.abs(F.col("va") - F.col("vb")))
    where = F.max_by(F.struct("feature", "sample"), F.struct("d", "feature", "sample"))
    g = d.agg(F.count("*").alias("n"), F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.corr("va", "vb").alias("r"), where.alias("w"))
    return g.select("n", "max_abs", "mean_abs", "rmse", "r", F.col("w.feature").alias("at_feature"), F.col("w.sample").alias("at_sample"), F.coalesce(F.col("max_abs") <= tolerance, F.lit(False)).alias("within"))


def missing(a: DataFrame, b: DataFrame, column: str = "feature") -> DataFrame:
    """Names of ``a`` that ``b`` lacks."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def concatenate(*results: DataFrame) -> DataFrame:
    """Results of more samples or more features: in long form both are a union by name."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def transpose(wide: DataFrame, row: str, column: str = "name", value: str = "value") -> DataFrame:
    """A wide matrix as long rows with its axes swapped."""
    rest = [c for c in wide.columns if c != row]
    return wide.unpivot([row], rest, column, value).select(F.col(column).alias("row"), F.col(row).alias("column"), value)


def wide(results: DataFrame, metric: str, samples: list[str] | None = None) -> DataFrame:
    """Features, in order, by samples of one metric; samples in order whatever their case unless given."""
    if samples is None:
        samples = [r["sample"] for r in results.select("sample").distinct().orderBy(F.lower("sample"), "sample").collect()]
    return results.groupBy("feature").pivot("sample", samples).agg(F.first(metric)).orderBy("feature")


def by_sample(results: DataFrame, metric: str) -> DataFrame:
    """Samples by features, in order, of one metric: for many samples, as only the features become columns."""
    features = [r["feature"] for r in results.select("feature").distinct().orderBy("feature").collect()]
    return results.groupBy("sample").pivot("feature", features).agg(F.first(metric))


def positional(a: DataFrame, b: DataFrame, metric: str = "zscore", tolerance: float = 1e-10) -> DataFrame:
    """``compare`` with the samples of both tables paired by their place instead of their name: ``pos`` where there is one, else
    the order of the names. Features go by name. Raises if the tables differ in shape.
    """

    def placed(t: DataFrame) -> DataFrame:
        order = [F.col("pos"), F.col("sample")] if "pos" in t.columns else [F.col("sample")]
        names = t.groupBy("sample").agg(*([F.min("pos").alias("pos")] if "pos" in t.columns else [F.count("*").alias("_c")]))
        place = names.withColumn("_i", F.row_number().over(Window.orderBy(*order))).select("sample", "_i")  # one row a sample
        return t.join(place, "sample").select("feature", F.col("_i").cast("string").alias("sample"), metric)

    shape = lambda t: tuple(t.agg(F.countDistinct("feature"), F.countDistinct("sample")).first())
    if (x := shape(a)) != (y := shape(b)):
        raise ValueError(f"the tables have {x[0]} x {x[1]} and {y[0]} x {y[1]} values")
    return compare(placed(a), placed(b), metric, tolerance)


def summary(results: DataFrame) -> DataFrame:
    """``metric, n, least, mean, most`` and how many features and samples there are."""
    long = results.unpivot(["feature", "sample"], list(METRICS), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"),
        F.countDistinct("feature").alias("features"), F.countDistinct("sample").alias("samples"),
    )


def attach(obs: DataFrame, results: DataFrame, metric: str | tuple[str, ...] = METRICS, strict: bool = False) -> DataFrame:
    """``obs`` with a map from feature to each metric (``activity_<metric>``); samples without results have null. Duplicates of
    ``obs`` stay. ``strict`` raises when samples of one side are missing on the other."""
    if strict:
        for x, y, side in ((obs, results, "results"), (results, obs, "obs")):
            if lost := missing(x, y, "sample").count():
                raise ValueError(f"{lost} samples are not in the {side}")
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.col(m).alias("v"))))).alias(f"activity_{m}") for m in ([metric] if isinstance(metric, str) else metric)]
    return obs.join(results.groupBy("sample").agg(*maps), "sample", "left")


def significant(results: DataFrame, p: float | None = None, z: float | None = None) -> DataFrame:
    out = results
    if p is not None:
        out = out.where(F.col("pvalue") < p)
    if z is not None:
        out = out.where(F.abs("zscore") > z)
    return out
