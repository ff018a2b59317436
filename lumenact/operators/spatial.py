"""Neighbourhoods of spots ``sample, x, y``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import sane
from .stats import nmf, spearman


def radius_pairs(spots: DataFrame, radius: float) -> DataFrame:
    """``a, b, d``: ordered pairs of different spots at most ``radius`` apart.

    Spots fall in square cells as wide as the radius; one side is copied to the nine cells around it and the sides meet
    by an equi-join, so only spots of neighbouring cells are compared.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    left = spots.select(F.col("sample").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), cell("x").alias("i"), cell("y").alias("j"))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    right = spots.select(F.col("sample").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cell("x").alias("i0"), cell("y").alias("j0"))
    right = right.withColumn("di", near).withColumn("dj", near).select("b", "xb", "yb", (F.col("i0") + F.col("di")).alias("i"), (F.col("j0") + F.col("dj")).alias("j"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    return left.join(right, ["i", "j"]).where(F.col("a") != F.col("b")).select("a", "b", d.alias("d")).where(F.col("d") <= radius)


def weights(spots: DataFrame, radius: float = 200.0, sigma: float = 100.0) -> DataFrame:
    """``a, b, w``: Gaussian weights within the radius, summing to 1 over ``b``."""
    g = radius_pairs(spots, radius).withColumn("g", F.exp(-(F.col("d") ** 2) / (2 * sigma**2)))
    return g.select("a", "b", (F.col("g") / F.sum("g").over(Window.partitionBy("a"))).alias("w"))


def neighbour_expression(expr: DataFrame, w: DataFrame, scale: float = 1e5) -> DataFrame:
    """``gene, sample, value``: log-normalised expression averaged over a spot's neighbours by weight."""
    total = F.sum(sane()).over(Window.partitionBy("sample"))
    norm = expr.select("gene", F.col("sample").alias("b"), F.log2(sane() / F.when(total == 0, 1.0).otherwise(total) * scale + 1).alias("v"))
    return norm.join(w, "b").groupBy("gene", F.col("a").alias("sample")).agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def neighbour_correlation(activity: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``feature, r, n, p``: Spearman's correlation of a feature's activity with its own gene around each spot.

    ``activity(feature, sample, value)``; spots without the gene nearby count as 0.
    """
    genes = neighbours.select(F.col("gene").alias("feature")).distinct()
    own = activity.join(genes, "feature", "left_semi").select("feature", "sample", F.col("value").alias("a"))
    around = neighbours.select(F.col("gene").alias("feature"), "sample", F.col("value").alias("b"))
    return spearman(own.join(around, ["feature", "sample"], "left").fillna(0.0, ["b"]), ["feature"], "a", "b")


#: Values of the matrix of features by spots that the driver factorises itself.
DRIVER_VALUES = 1 << 25


def patterns(activity: DataFrame, correlations: DataFrame, k: int | list[int], p_cutoff: float = 0.05) -> tuple[DataFrame, DataFrame, int] | None:
    """``feature, pattern, weight`` and ``pattern, sample, weight`` of the significant features, and the number of
    patterns: of several candidates the one of the lowest error. None with fewer than two significant features.

    A matrix of at most ``DRIVER_VALUES`` values is factorised on the driver, a larger one by blocks of spots in tasks.
    """
    spark = activity.sparkSession
    names = [r["feature"] for r in correlations.where(F.col("p") < p_cutoff).select("feature").distinct().orderBy("feature").collect()]
    ks = list(k) if isinstance(k, list | tuple) else [k]
    known = spark.createDataFrame([(f, i) for i, f in enumerate(names)], "feature string, i int")
    rows = activity.join(known, "feature").groupBy("sample", "i").agg(F.max(sane()).alias("v"))
    if len(names) < 2 or (spots := rows.select("sample").distinct().count()) == 0:
        return None
    right = "pattern string, sample string, weight double"
    if len(names) * spots > DRIVER_VALUES:
        by_spot = rows.groupBy("sample").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))
        fits = {c: nmf_in_blocks(by_spot, len(names), c) for c in ks}
        best = min(fits, key=lambda c: fits[c][2])
        w, h, _ = fits[best]
        side = h.select(F.posexplode("h").alias("j", "weight"), "sample").select((F.col("j") + 1).cast("string").alias("pattern"), "sample", "weight")
    else:
        t = rows.orderBy("sample").toArrow()
        samples = t.column("sample").combine_chunks().dictionary_encode()
        m = np.zeros((len(names), len(samples.dictionary)))
        m[t.column("i").to_numpy(), samples.indices.to_numpy()] = t.column("v").to_numpy()
        fits = {c: nmf(m, c) for c in ks}
        best = min(fits, key=lambda c: fits[c][2])
        w, h, _ = fits[best]
        order = samples.dictionary.to_pylist()
        side = spark.createDataFrame([(str(j + 1), s, float(h[j, i])) for i, s in enumerate(order) for j in range(best)], right)
    left = [(f, str(j + 1), float(w[i, j])) for i, f in enumerate(names) for j in range(best)]
    return spark.createDataFrame(left, "feature string, pattern string, weight double"), side, best


def nmf_in_blocks(spots: DataFrame, n: int, k: int, seed: int = 123456, iterations: int = 200) -> tuple[np.ndarray, DataFrame, float]:
    """Non-negative factors of the matrix whose columns are the rows ``sample, i, v`` (places and values): the features' side,
    ``sample, h`` and the Frobenius error, by the coordinate descent of ``stats.nmf``.

    The spots' side stays with the spots. A pass updates it within blocks, given the features' side, and sums up what the
    latter's update needs: k x k and features x k numbers a task. Every tenth pass is checkpointed.
    """
    spark = spots.sparkSession
    mean = spots.agg(F.sum(F.expr("aggregate(v, 0D, (s, x) -> s + greatest(x, 0D))")) / (F.count("*") * n)).first()[0] or 0.0
    size = math.sqrt(max(mean, 1e-12) / k)
    w = np.abs(size * np.random.RandomState(seed).standard_normal((n, k)))

    def dense(b: pa.RecordBatch) -> np.ndarray:
        idx, out = b.column("i"), np.zeros((b.num_rows, n))
        out[np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy())), idx.flatten().to_numpy()] = b.column("v").flatten().to_numpy()
        return np.maximum(np.nan_to_num(out), 0)

    def started(batches):
        for b in batches:
            h = np.stack([np.abs(size * np.random.RandomState(s & 0xFFFFFFFF).standard_normal(k)) for s in b.column("s").to_pylist()]) if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("sample", "i", "v")], pa.array(list(h), pa.list_(pa.float64()))], ["sample", "i", "v", "h"])

    kind = "sample string, i array<int>, v array<double>, h array<double>"
    now = spots.withColumn("s", F.xxhash64("sample")).mapInArrow(started, kind).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(batches):
        gram, cross, square = np.zeros((k, k)), np.zeros((n, k)), 0.0
        for b in batches:
            v, h = dense(b), np.array(b.column("h").to_pylist(), float).reshape(b.num_rows, k)
            gram += h.T @ h
            cross += v.T @ h
            square += float((v**2).sum())
        flat = np.concatenate([gram.ravel(), cross.ravel(), [square]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    def totals(frame: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        got = frame.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow().column("value").to_numpy()
        return got[: k * k].reshape(k, k), got[k * k : -1].reshape(n, k), float(got[-1])

    def moved(w: np.ndarray):
        gram = w.T @ w

        def run(batches):
            for b in batches:
                h, cross = np.array(b.column("h").to_pylist(), float).reshape(b.num_rows, k), dense(b) @ w
                for j in range(k):
                    if gram[j, j] > 0:
                        h[:, j] = np.maximum(0, h[:, j] + (cross[:, j] - h @ gram[:, j]) / gram[j, j])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("sample", "i", "v")], pa.array(list(h), pa.list_(pa.float64()))], ["sample", "i", "v", "h"])

        return run

    last, err = np.inf, 0.0
    gram, cross, square = totals(now)
    for step in range(iterations):
        for j in range(k):
            if gram[j, j] > 0:
                w[:, j] = np.maximum(0, w[:, j] + (cross[:, j] - w @ gram[:, j]) / gram[j, j])
        after = now.mapInArrow(moved(w.copy()), kind)
        after = after.checkpoint() if step % 10 == 9 and spark.sparkContext.getCheckpointDir() else after.persist(StorageLevel.MEMORY_AND_DISK)
        gram, cross, square = totals(after)
        now.unpersist()
        now = after
        err = math.sqrt(max(square - 2 * float((w * cross).sum()) + float(((w.T @ w) * gram).sum()), 0.0))
        if last - err < 1e-6 * max(1.0, last):
            break
        last = err
    return w, now.select("sample", "h"), err


def pattern_genes(w: DataFrame, pattern: str) -> DataFrame:
    """Features whose largest weight is the pattern's, largest first."""
    top = w.groupBy("feature").agg(F.max_by(F.struct("pattern", "weight"), F.struct("weight", F.expr("-int(pattern)"))).alias("m"))
    return top.select("feature", "m.pattern", "m.weight").where(F.col("pattern") == pattern).orderBy(F.col("weight").desc(), "feature")


def density(spots: DataFrame, width: float) -> DataFrame:
    """``bx, by, n``: spots of each square."""
    return spots.groupBy(F.floor(F.col("x") / width).alias("bx"), F.floor(F.col("y") / width).alias("by")).agg(F.count("*").alias("n"))


def as_matrix(long: DataFrame, rows: str, columns: str, value: str) -> tuple[np.ndarray, list[str], list[str]]:
    """A driver-size long table as a matrix with sorted names."""
    p = long.toPandas().pivot(index=rows, columns=columns, values=value).sort_index().sort_index(axis=1)
    return p.to_numpy(), list(p.index), list(p.columns)
