"""Problem 4: the top items of every group by a ``row_number`` window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_results(activity: DataFrame) -> DataFrame:
    """``sample, feature, run_id, zscore, pvalue``: results with a valid ``zscore``, once each.

    Copies agree; should they differ, the highest ``zscore`` and the lowest ``pvalue`` count. NaN p-values become null.
    The copies of a map task merge before the shuffle, and a hot sample is spread by feature and run.
    """
    p = F.when(~F.isnan("pvalue"), F.col("pvalue"))
    rows = activity.where("zscore is not null and not isnan(zscore)").select("sample", "feature", "run_id", "zscore", p.alias("pvalue"))
    return rows.groupBy("sample", "feature", "run_id").agg(F.max("zscore").alias("zscore"), F.min("pvalue").alias("pvalue"))


def top_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, with ``rank_no`` from 1.

    The rank filter on ``row_number`` lets Spark put a group limit on both sides of the shuffle: a task sends at most
    ``n`` rows of a group, so a group of any size is cheap. ``order`` should be total, else ties are broken arbitrarily.
    Null groups are one group; a column named ``rank_no`` is replaced.
    """
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank_no") <= n)


def top_results(activity: DataFrame, n: int) -> DataFrame:
    """Of every sample its first ``n`` results: ``zscore`` descending, ``pvalue`` ascending with null and NaN last,
    ``feature`` by bytes, ``run_id``."""
    order = [F.col("zscore").desc(), F.col("pvalue").asc_nulls_last(), F.col("feature").asc(), F.col("run_id").asc()]
    return top_n(unique_results(activity), ["sample"], order, n)
