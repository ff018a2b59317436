"""Cells and their profiles, the common input of problems 1, 3 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Characters that count as white space in labels, beside ``_`` and ``-``.
_LABEL_GAP = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000_\-]+"
#: Labels that form no group (fixed values).
NO_LABEL = ("", "na", "n/a", "unknown", "unassigned")


def clean_label(column: str):
    """A label in lower case, its gaps one space, none at the ends; null for a placeholder."""
    text = F.trim(F.regexp_replace(F.lower(F.col(column)), _LABEL_GAP, " "))
    return F.when(~text.isin(*NO_LABEL), text)


def cells(obs: DataFrame) -> DataFrame:
    """One row a sample with its clean label.

    Rows that occur twice agree; where labels of one sample differ the smallest clean label is kept.
    """
    return obs.where("sample is not null").groupBy("sample").agg(F.min(clean_label("annotation")).alias("annotation"))


def profiles(activity: DataFrame, obs: DataFrame, panel: DataFrame, value: str, tier: str = "core") -> DataFrame:
    """``sample, annotation, vec``: one row a cell, ``vec`` its values of the tier's features by ``pos``.

    * null, NaN and absent values are 0; copies of a result count once;
    * a cell with results of several runs takes the largest value of each feature;
    * a sample of ``activity`` without a row in ``obs`` is no cell, and neither is a null sample;
    * a cell without any row of the tier has the zero profile; an empty table gives an empty result.

    The maximum has a buffer of one double a feature, so a sample of any number of rows, hot or not, becomes one
    partial row a map task before the only shuffle of the large table. ``panel`` is a dimension of fixed size.
    """
    own = panel.where(F.col("tier") == tier)
    places = [r["pos"] for r in own.select("pos").orderBy("pos").collect()]
    position = own.select("feature", F.col("pos").alias("_at"))
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    rows = activity.where("sample is not null").select("sample", "feature", v.alias("_v")).join(position, "feature", "left")
    wide = rows.groupBy("sample").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("_at") == p, F.col("_v"))).alias(f"v{i}") for i, p in enumerate(places)])
    vec = F.array(*[F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in range(len(places))]) if places else F.expr("array(0D)")
    return wide.select("sample", vec.alias("vec")).join(cells(obs), "sample").select("sample", "annotation", "vec")


def cell_profiles(spark: SparkSession, sf_dir: str, value: str = "zscore") -> DataFrame:
    """The profiles of the given tables, written once since the operators read them in several passes."""
    return written(profiles(table(spark, sf_dir, "activity"), table(spark, sf_dir, "obs"), table(spark, sf_dir, "panel"), value))
