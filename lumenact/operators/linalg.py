"""Matrices of signature size on the driver, and the operators on signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import sane


def signature_matrix(sig: DataFrame, genes: list[str]) -> tuple[np.ndarray, list[str]]:
    """``sig(gene, feature, weight)`` as a matrix of ``genes`` by sorted features; absent, null and NaN weights are 0.

    A signature has the size of a genome times a panel, not of the data, and fits the driver.
    """
    rows = sig.groupBy("gene", "feature").agg(F.max(sane("weight")).alias("w")).toArrow()
    named = rows.column("feature").combine_chunks().dictionary_encode()
    features = sorted(named.dictionary.to_pylist())
    place = np.argsort(np.argsort(np.array(named.dictionary.to_pylist(), object), kind="stable"), kind="stable")
    column = place[named.indices.to_numpy()] if len(named) else np.zeros(0, int)
    row = pc.index_in(rows.column("gene"), pa.array(genes, pa.string())).to_numpy()
    weight = rows.column("w").to_numpy()
    x, known = np.zeros((len(genes), len(features))), ~np.isnan(row.astype(float))
    x[row[known].astype(int), column[known]] = weight[known]
    return x, features


def standardise(x: np.ndarray) -> np.ndarray:
    """Columns to mean 0 and sample deviation 1; columns without spread become 0."""
    sd = x.std(0, ddof=1)
    return np.nan_to_num(np.divide(x - x.mean(0), sd, out=np.zeros_like(x), where=sd > 0))


def projection(x: np.ndarray, lam: float = 5e5) -> np.ndarray:
    """(X'X + lam I)^-1 X' by Cholesky; the pseudo-inverse where that fails."""
    if lam < 0:
        raise ValueError("lambda must not be negative")
    gram = x.T @ x + lam * np.eye(x.shape[1])
    try:
        low = np.linalg.cholesky(gram)
        return np.linalg.solve(low.T, np.linalg.solve(low, x.T))
    except np.linalg.LinAlgError:
        return np.linalg.pinv(gram) @ x.T


def _complete_linkage(d: np.ndarray, cut: float) -> np.ndarray:
    """Groups after merging the closest pair, by their farthest members, while that is at most ``cut`` apart."""
    d, n = d.copy(), len(d)
    np.fill_diagonal(d, np.inf)
    group = np.arange(n)
    while n > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] <= cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        group[group == group[j]] = group[i]
    return group


def group_features(x: np.ndarray, features: list[str], threshold: float = 0.9) -> tuple[np.ndarray, list[str]]:
    """Features correlated above ``threshold`` (complete linkage on 1 - r) replaced by their mean, named ``a|b``."""
    if x.shape[1] < 2:
        return x, list(features)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x.T)
    groups = _complete_linkage(np.where(np.isnan(r), 1.0, 1 - r), 1 - threshold)
    out, names = [], []
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        out.append(x[:, own].mean(1))
        names.append("|".join(sorted(features[i] for i in own)))
    return np.stack(out, 1), names


def expand_features(rows: DataFrame) -> DataFrame:
    """A row a member for every grouped feature ``a|b``."""
    return rows.withColumn("feature", F.explode(F.split("feature", r"\|")))


def correlation_pairs(sig: DataFrame) -> DataFrame:
    """``feature_a, feature_b, r``: Pearson's correlation of each pair of features over the genes both have.

    Sums over common genes are products of the signature's matrix, which fits the driver, and of the mask of its rows; null
    where a feature has no spread over them, and no row for features without a common gene.
    """
    rows = sig.where("gene is not null and feature is not null").groupBy("gene", "feature").agg(F.max(sane("weight")).alias("w")).toArrow()
    kind = "feature_a string, feature_b string, r double"
    if not len(rows):
        return sig.sparkSession.createDataFrame([], kind)
    named, gene = (rows.column(c).combine_chunks().dictionary_encode() for c in ("feature", "gene"))
    order = np.argsort(np.array(named.dictionary.to_pylist(), object), kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    features = np.array(named.dictionary.to_pylist(), object)[order]
    x, has = np.zeros((len(gene.dictionary), len(features))), np.zeros((len(gene.dictionary), len(features)))
    at = gene.indices.to_numpy(), place[named.indices.to_numpy()]
    x[at], has[at] = rows.column("w").to_numpy(), 1.0
    x -= x.sum(0) / np.maximum(has.sum(0), 1) * has  # near 0, so that the sums of squares cancel little
    n, sum_a, square_a, both = has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x
    top = n * both - sum_a * sum_a.T
    a, b = n * square_a - sum_a**2, (n * square_a - sum_a**2).T
    low = np.sqrt(np.maximum(a, 0) * np.maximum(b, 0))
    ok = low > 1e-12 * n * np.sqrt(np.maximum(square_a * square_a.T, 1e-300))
    r = np.divide(top, low, out=np.full_like(top, np.nan), where=ok)
    i, j = np.nonzero(np.triu(n, 1))
    value = pa.array(np.clip(r[i, j], -1, 1), from_pandas=True)
    return sig.sparkSession.createDataFrame(pa.table([pa.array(features[i], pa.string()), pa.array(features[j], pa.string()), value], names=["feature_a", "feature_b", "r"]), kind)


def mean_signatures(sig: DataFrame, groups: DataFrame) -> DataFrame:
    """Features averaged by ``groups(feature, grp)``."""
    return sig.join(F.broadcast(groups), "feature").groupBy("gene", F.col("grp").alias("feature")).agg(F.avg(sane("weight")).alias("weight"))


def validate_signature(sig: DataFrame) -> DataFrame:
    """One row of counts: weights missing, features without spread, genes named twice, all-zero genes and features."""
    w = sane("weight")
    missing = sig.agg(F.count_if(F.col("weight").isNull() | F.isnan("weight")).alias("n_missing"))
    per_feature = sig.groupBy("feature").agg(F.coalesce(F.stddev_samp(w), F.lit(0.0)).alias("sd"), F.max(F.abs(w)).alias("m"))
    feature = per_feature.agg(F.count("*").alias("n_features"), F.count_if(F.col("sd") < 1e-12).alias("n_flat"), F.count_if(F.col("m") == 0).alias("n_zero_features"))
    twice = sig.groupBy("gene", "feature").count().groupBy("gene").agg(F.max("count").alias("c"))
    gene = twice.agg(F.count("*").alias("n_genes"), F.count_if(F.col("c") > 1).alias("n_repeated_genes"))
    zero = sig.groupBy("gene").agg(F.max(F.abs(w)).alias("m")).agg(F.count_if(F.col("m") == 0).alias("n_zero_genes"))
    return missing.join(feature).join(gene).join(zero)
