"""Ranks, correlations, survival curves and regressions over long tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_p, t_p_value
from .ranks import quantiles, with_average_ranks


def spearman(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """``by, r, n, p``: Spearman's correlation of finite pairs, p by the t distribution (NaN with fewer than 3 pairs).

    The pairs are read several times and stay cached until the session's cache is cleared.
    """
    ok = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(*by, a, b).persist(StorageLevel.MEMORY_AND_DISK)
    ranked = with_average_ranks(ok, by, {a: "_a", b: "_b"})
    r = ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))
    df = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(df / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return r.withColumn("p", t_p_value(t, df))


#: Ranges of a group's times, each ordered by a task of its own.
TIME_RANGES = 64


def kaplan_meier(subjects: DataFrame, group: str, time: str = "time", event: str = "event", label: str = "sample") -> DataFrame:
    """``group, label, time, at_risk, survival``: the curve after every subject, in order of time and, at ties, label.

    The running product is a sum of logarithms; the last subject at risk with an event takes it to 0. A group is cut at
    quantiles of its times into ranges that are ordered apart; sums over the ranges before one give where it begins.
    """
    rows = subjects.select(group, label, time, event)
    inner = [i / TIME_RANGES for i in range(1, TIME_RANGES)]
    cuts = rows.groupBy(group).agg(F.percentile_approx(F.col(time).cast("double"), inner).alias("_cuts"), F.count("*").alias("_n"))
    same = F.col(f"s.{group}").eqNullSafe(F.col(f"c.{group}"))
    part = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(time)))
    rows = rows.alias("s").join(cuts.alias("c"), same).select("s.*", "_n", part.alias("_part"))
    by, here = Window.partitionBy(group), Window.partitionBy(group, "_part")
    order = here.orderBy(time, label)
    size = rows.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    upto = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select(group, "_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        on = F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")) & (F.col("l._part") == F.col("r._part"))
        return left.alias("l").join(right.alias("r"), on).select("l.*", *[f"r.{c}" for c in right.columns if c not in (group, "_part")])

    rows = met(rows, start).withColumn("at_risk", F.col("_n") - F.col("_start") - F.row_number().over(order) + 1)
    died = F.coalesce(F.col(event) == 1, F.lit(False))
    rows = rows.withColumn("_log", F.when(died & (F.col("at_risk") > 1), F.ln((F.col("at_risk") - 1) / F.col("at_risk"))).otherwise(0.0))
    logs = rows.groupBy(group, "_part").agg(F.sum("_log").alias("_sum"))
    before = logs.select(group, "_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_before"))
    run = F.col("_before") + F.sum("_log").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = died & (F.col("at_risk") == 1)  # no subject comes after it
    return met(rows, before).select(group, label, time, "at_risk", F.when(last, 0.0).otherwise(F.exp(run)).alias("survival"))


def median_split(rows: DataFrame, value: str, by: list[str], name: str = "grp") -> DataFrame:
    """``rows`` with ``high`` for values above the median of ``by``, else ``low``."""
    m = quantiles(rows, by, value, {"_m": 0.5}).drop("n")
    joined = rows.join(m, by) if by else rows.join(F.broadcast(m))
    return joined.withColumn(name, F.when(F.col(value) > F.col("_m"), "high").otherwise("low")).drop("_m")


def _fail(p: int) -> dict:
    return {"beta": np.zeros(p), "se": np.zeros(p), "z": np.zeros(p), "p": np.ones(p), "converged": False, "iterations": 0}


def logistic_regression(rows: DataFrame, y: str, xs: list[str], firth: bool = False, alternative: str = "two-sided", tol: float = 1e-6, max_delta: float = 5.0, max_iter: int = 200) -> dict:
    """Newton's method for a logit model without an intercept of its own, optionally with Firth's correction.

    An iteration is one aggregate over all rows: X'WX and X'(y - P), as sums of products in the JVM; only p x p numbers
    come back. A singular information matrix gives zeros, p of 1 and ``converged`` false.
    """
    k = len(xs)
    x = [F.col(c).cast("double") for c in xs]
    rows = rows.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], F.col(y).cast("double").alias("y")).dropna().persist()
    beta, inv, converged, u = np.zeros(k), None, False, np.zeros(k)
    iteration = 0
    try:
        for iteration in range(max_iter):
            eta = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
            e = F.exp(-F.abs(eta))
            prob = F.when(eta >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
            state = rows.withColumn("p", prob).withColumn("w", F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-10)))
            sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
            got = state.agg(*sums, *[F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))) for i in range(k)]).first()
            if got[0] is None:
                return _fail(k)
            info = np.zeros((k, k))
            info[np.triu_indices(k)] = got[: k * (k + 1) // 2]
            info = info + np.triu(info, 1).T
            u = np.array(got[k * (k + 1) // 2 :], float)
            try:
                np.linalg.cholesky(info)
            except np.linalg.LinAlgError:
                return _fail(k) | {"iterations": iteration}
            inv = np.linalg.inv(info)
            if firth:  # the diagonal of the weighted hat matrix is a quadratic form in the row
                h = sum((F.col(f"x{i}") * F.col(f"x{j}") * float(inv[i, j]) for i in range(k) for j in range(k)), F.lit(0.0)) * F.col("w")
                more = state.agg(*[F.sum(F.col(f"x{i}") * h * (F.col("p") - 0.5)) for i in range(k)]).first()
                u = u - np.array(more, float)
            if np.linalg.norm(u) < tol:
                converged = True
                break
            step = inv @ u
            ratio = (float(np.linalg.norm(step)) + 1) / (float(np.linalg.norm(beta)) + 1)
            beta = beta + step * min(1.0, max_delta / ratio)
    finally:
        rows.unpersist()
    se = np.sqrt(np.maximum(np.diag(inv), 0))
    z = np.divide(beta, se, out=np.zeros(k), where=se > 0)
    return {"beta": beta, "se": se, "z": z, "p": np.where(se > 0, normal_p(z, alternative), 1.0), "converged": converged, "iterations": iteration}


def logit(rows: DataFrame, y: str, xs: list[str], alternative: str = "two-sided", firth: bool = True) -> DataFrame:
    """``term, beta, se, z, p`` of a logit model with Firth's correction by default."""
    fit = logistic_regression(rows, y, xs, firth, alternative)
    out = [(n, *(float(fit[k][i]) for k in ("beta", "se", "z", "p"))) for i, n in enumerate(xs)]
    return rows.sparkSession.createDataFrame(out, "term string, beta double, se double, z double, p double")


def risk_by_rank(activity: DataFrame, subjects: DataFrame, time: str = "time") -> DataFrame:
    """``feature, r, n, p``: Spearman's correlation of each feature's activity ``value`` with survival time."""
    return spearman(activity.join(subjects.select("sample", F.col(time).alias("_t")), "sample"), ["feature"], "value", "_t")


def cox(rows: DataFrame, by: str, time: str, event: str, xs: list[str], min_rows: int = 5) -> DataFrame:
    """``by, risk_score_z, p_value, n``: a proportional-hazards fit of every group (Efron's ties), Wald's z of ``xs[0]``.

    Rows with a missing value drop out; a group of fewer than ``min_rows`` rows, without spread in ``xs[0]`` or whose fit
    fails has no row. A group is one feature over the subjects of a study, which fits a task.
    """
    cols = [by, time, event, *xs]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _cox_fit(pdf[time].to_numpy(float), pdf[event].to_numpy(float), pdf[xs].to_numpy(float))
        if out is None:
            return pdf[[by]].head(0).assign(risk_score_z=np.zeros(0), p_value=np.zeros(0), n=np.zeros(0, np.int64))
        z = out[0] / out[1]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "risk_score_z": [z], "p_value": [float(normal_p(np.array([z]))[0])], "n": [len(pdf)]})

    clean = rows.select(*cols).dropna()
    spread = clean.groupBy(by).agg(F.count("*").alias("_n"), F.stddev_samp(xs[0]).alias("_s")).where((F.col("_n") >= min_rows) & (F.col("_s") >= 1e-10)).select(by)
    kind = dict(rows.dtypes)[by]
    return clean.join(spread, by, "left_semi").groupBy(by).applyInPandas(one, f"{by} {kind}, risk_score_z double, p_value double, n long")


#: Newton's steps of a proportional-hazards fit; one that has a maximum needs fewer than ten.
COX_STEPS = 20


def _cox_fit(time: np.ndarray, event: np.ndarray, x: np.ndarray) -> tuple[float, float] | None:
    order = np.argsort(-time, kind="stable")
    time, event, x = time[order], event[order], x[order]
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    b = np.zeros(x.shape[1])
    ends = np.flatnonzero(np.append(np.diff(time) != 0, True)) + 1
    for _ in range(COX_STEPS):
        w = np.exp(np.clip(x @ b, -50, 50))
        s0, s1 = np.cumsum(w), np.cumsum(w[:, None] * x, 0)
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], 0)
        grad, info, start = np.zeros_like(b), np.zeros((len(b), len(b))), 0
        for end in ends:
            dead = np.flatnonzero(event[start:end] == 1) + start
            for k in range(len(dead)):
                f = k / len(dead)
                wd = w[dead]
                a0 = s0[end - 1] - f * wd.sum()
                a1 = s1[end - 1] - f * (wd[:, None] * x[dead]).sum(0)
                a2 = s2[end - 1] - f * (wd[:, None, None] * x[dead][:, :, None] * x[dead][:, None, :]).sum(0)
                grad -= a1 / a0
                info += a2 / a0 - np.outer(a1, a1) / a0**2
            grad += x[dead].sum(0)
            start = end
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            return None
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    else:  # the likelihood has no maximum, as where values part the events from the others
        return None
    try:
        var = np.linalg.inv(info)[0, 0]
    except np.linalg.LinAlgError:
        return None
    if not (np.isfinite(var) and var > 0):
        return None
    return float(b[0]), math.sqrt(var)


def fit_line(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, n, slope, intercept, r`` of finite pairs; null line with two pairs or fewer."""
    ok = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    g = ok.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))
    return g.select(*by, "n", *[F.when(F.col("n") > 2, F.col(c)).alias(c) for c in ("slope", "intercept", "r")])


def nmf(v: np.ndarray, k: int, seed: int = 123456, iterations: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-negative factors of a matrix of features by spots (driver size) by coordinate descent; the Frobenius error."""
    v = np.maximum(np.nan_to_num(v), 0)
    rng = np.random.RandomState(seed)
    size = math.sqrt(max(v.mean(), 1e-12) / k)
    w, h = np.abs(size * rng.standard_normal((v.shape[0], k))), np.abs(size * rng.standard_normal((k, v.shape[1])))
    last = np.inf
    for _ in range(iterations):
        for a, b, target in ((w, h, v), (h.T, w.T, v.T)):
            gram, cross = b @ b.T, target @ b.T
            for j in range(k):
                if gram[j, j] > 0:
                    a[:, j] = np.maximum(0, a[:, j] + (cross[:, j] - a @ gram[:, j]) / gram[j, j])
        err = float(np.linalg.norm(v - w @ h))
        if last - err < 1e-9 * max(1.0, last):
            break
        last = err
    return w, h, float(np.linalg.norm(v - w @ h))
