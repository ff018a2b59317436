"""Exact ranks and quantiles of groups of any size.

Equal values merge first, in the map tasks, so ties cost nothing. The distinct values of a group are then spread over
buckets by approximate cut points; ranks count up within a bucket and start at the sum of the buckets before. No group is
sorted by one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 32
#: Distinct values that one task may rank alone; beyond them a group is spread.
ONE_TASK = 200_000


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, c, upto, n``: each distinct value with its rows, the rows up to it and the rows of its group.

    Null and NaN are no values; null keys are a group.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(value).cast("double").alias("_v"))
    keys = [f"_b{i}" for i in range(len(by))] or ["_b"]
    if not by:
        rows = rows.withColumn("_b", F.lit(0))
    same = lambda l, r: [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in keys]  # noqa: E731, E741
    distinct = rows.groupBy(*keys, "_v").agg(F.count("*").alias("c"))
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = distinct.groupBy(*keys).agg(F.when(F.count("*") > ONE_TASK, F.percentile_approx("_v", shares, 200)).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    placed = distinct.alias("d").join(cuts.alias("q"), same("d", "q")).select("d.*", F.size(F.filter("q._cuts", lambda x: x < F.col("d._v"))).alias("_k"))
    whole = Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "_k").agg(F.sum("c").alias("_m"))
    sizes = sizes.select(*keys, "_k", (F.sum("_m").over(whole.orderBy("_k")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("n"))
    inside = placed.withColumn("_upto", F.sum("c").over(Window.partitionBy(*keys, "_k").orderBy("_v")))
    both = inside.alias("i").join(sizes.alias("s"), [*same("i", "s"), F.col("i._k") == F.col("s._k")])
    return both.select(*[F.col(f"i._b{i}").alias(b) for i, b in enumerate(by)], F.col("i._v").alias(value), "i.c", (F.col("i._upto") + F.col("s._before")).alias("upto"), "s.n")


def with_average_ranks(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """``rows`` that have all values, with the rank of each column ``names`` has within ``by``, ties at their mean.

    Groups that one task can sort are ranked by a window; if any is larger, all go by distinct values. Both are exact.
    """
    out = rows.where(reduce(and_, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) for v in names]))
    largest = out.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= 5 * ONE_TASK:
        for value, name in names.items():
            rank = F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
            out = out.withColumn(name, rank)
        return out
    valid = out
    for value, name in names.items():
        ranks = value_ranks(valid, by, value)
        ranks = ranks.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], F.col(value).alias("_rv"), (F.col("upto") - (F.col("c") - 1) / 2).alias(name))
        same = [F.col(b).eqNullSafe(F.col(f"_r{i}")) for i, b in enumerate(by)] + [F.col(value).cast("double") == F.col("_rv")]
        out = out.join(ranks, same).drop("_rv", *[f"_r{i}" for i in range(len(by))])
    return out


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by, n`` and a column for each wanted share: quantiles interpolated between the two nearest rows."""
    ranks = value_ranks(rows, by, value)

    def at(row):
        return F.max(F.when((F.col("upto") >= row) & (F.col("upto") - F.col("c") < row), F.col(value)))

    parts = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("n") - 1)
        low = F.floor(place) + 1
        parts += [at(low).alias(f"{name}_lo"), at(F.ceil(place) + 1).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_f")]
    found = ranks.groupBy(*by).agg(F.max("n").alias("n"), *parts)
    return found.select(*by, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * F.col(f"{k}_f")).alias(k) for k in wanted])
