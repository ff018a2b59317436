"""Problem 3: clusters of similar records by a Gaussian mixture.

Features are standardised and reduced by principal components; the mixture has diagonal covariances, regularised towards
the overall variance. Every pass of expectation-maximisation covers all rows: a task turns its rows into sums per
component, and the sums of all tasks add up in one small shuffle, for every candidate number of components at once.
The Bayesian information criterion chooses among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balls import PAIRS, chains, distances
from .cftree import leaf_entries, ward
from .common import lists, summed, vectors, written
from .topn import top_n


@dataclass
class Reduction:
    mean: np.ndarray
    axes: np.ndarray  # standardises and rotates: (x - mean) @ axes

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_densities(self, z: np.ndarray) -> np.ndarray:
        """``log(weight * density)`` of every row under every component."""
        inv = 1 / self.var
        d = (z**2) @ inv.T - 2 * z @ (self.mean * inv).T + (self.mean**2 * inv).sum(1)
        return np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (d + np.log(self.var).sum(1) + z.shape[1] * np.log(2 * np.pi))


def reduction(points: DataFrame, share: float = 0.9, most: int | None = None) -> Reduction | None:
    """Principal axes of the standardised columns of ``vec`` that hold ``share`` of the variance, at most ``most`` if given;
    None without rows."""

    def moments(batches):
        total = None
        for b in batches:
            x = vectors(b.column("vec"))
            if len(x):
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    rows = sorted((r["at"], r["value"]) for r in summed(points.select("vec").mapInArrow(moments, "at int, value double"), ["at"]).collect())
    if not rows:
        return None
    total = np.array([v for _, v in rows])
    d = int(round(len(total) ** 0.5))
    total = total.reshape(d, d)
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0.0)
    values, axes = np.linalg.eigh(cov * scale[:, None] * scale[None])
    order = np.argsort(-values)
    held = np.cumsum(values[order]) / max(values.sum(), 1e-300)
    keep = order[: max(1, min(most or len(order), int(np.searchsorted(held, share)) + 1))]
    return Reduction(mean, scale[:, None] * axes[:, keep])


def _start(n: np.ndarray, centre: np.ndarray, spread: np.ndarray, k: int, overall: np.ndarray) -> Mixture:
    """A mixture of ``k`` components from leaf entries joined by Ward linkage."""
    group = ward(n, centre, k)
    k = group.max() + 1
    weight, mean, var = np.zeros(k), np.zeros((k, centre.shape[1])), np.zeros((k, centre.shape[1]))
    np.add.at(weight, group, n)
    np.add.at(mean, group, n[:, None] * centre)
    mean /= weight[:, None]
    np.add.at(var, group, n[:, None] * ((centre - mean[group]) ** 2 + spread[:, None]))
    return Mixture(weight / weight.sum(), mean, var / weight[:, None] + 0.01 * overall)


def _step(mixtures: list[Mixture]) -> int:
    """Rows at once, such that their densities under the components are about ``PAIRS`` at most."""
    return max(64, min(4096, PAIRS // max(len(m.weight) for m in mixtures)))


def _em(points: DataFrame, reduce: Reduction, mixtures: list[Mixture], overall: np.ndarray) -> tuple[list[Mixture], list[float], float]:
    """One step of all mixtures: the next mixtures, the log-likelihoods of the given ones and the number of rows."""
    sent = points.sparkSession.sparkContext.broadcast((reduce, mixtures))

    def expect(batches):
        reduce, mixtures = sent.value
        sums = [np.zeros((len(m.weight), 2 * m.mean.shape[1] + 1)) for m in mixtures]
        ll, rows, step = np.zeros(len(mixtures)), 0, _step(mixtures)
        for b in batches:
            whole = vectors(b.column("vec"))
            for at in range(0, len(whole), step):
                z = reduce(whole[at : at + step])
                moments = np.hstack([np.ones((len(z), 1)), z, z**2])
                rows += len(z)
                for i, m in enumerate(mixtures):
                    log = m.log_densities(z)
                    top = log.max(1, keepdims=True)
                    p = np.exp(log - top)
                    norm = p.sum(1, keepdims=True)
                    ll[i] += float((top + np.log(norm)).sum())
                    sums[i] += (p / norm).T @ moments
        for i, s in enumerate(sums):
            k, j = np.indices(s.shape, np.int32)
            own = [np.full(s.size + 2, i, np.int32), np.append(k.ravel(), [-1, -2]), np.append(j.ravel(), [0, 0]), np.append(s.ravel(), [ll[i], rows])]
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1].astype(np.int32)), pa.array(own[2].astype(np.int32)), pa.array(own[3])], ["m", "k", "j", "value"])

    got = summed(points.select("vec").mapInArrow(expect, "m int, k int, j int, value double"), ["m", "k", "j"]).toArrow().to_pandas()
    out, lls, n = [], [], 0.0
    for i, m in enumerate(mixtures):
        own = got[got["m"] == i]
        lls.append(float(own.loc[own["k"] == -1, "value"].iloc[0]))
        n = float(own.loc[own["k"] == -2, "value"].iloc[0])
        own = own[own["k"] >= 0]
        s = np.zeros((len(m.weight), 2 * m.mean.shape[1] + 1))
        s[own["k"], own["j"]] = own["value"]
        s = s[s[:, 0] > 1e-6 * n / len(s)]  # a component that lost all its rows goes
        d, nk = m.mean.shape[1], s[:, :1]
        mean = s[:, 1 : d + 1] / nk
        var = np.maximum(s[:, d + 1 :] / nk - mean**2, 0)
        prior = 2.0  # regularised as by so many rows of a tenth of the overall variance
        out.append(Mixture(nk[:, 0] / n, mean, (var * nk + prior * 0.1 * overall) / (nk + prior)))
    return out, lls, n


def _stepped(points: DataFrame, reduce: Reduction, mixtures: list[Mixture], overall: np.ndarray, passes: int | None) -> tuple[list[Mixture], list[float], float]:
    """Mixtures after ``passes`` steps, or after as many as each takes until its log-likelihood changes by less than 1e-3
    a row; their log-likelihoods and the number of rows.

    A step never lowers the likelihood with the prior of the variances, so the changes end."""
    out, lls, going, done = list(mixtures), [-np.inf] * len(mixtures), list(range(len(mixtures))), 0
    while going:
        after, now, total = _em(points, reduce, [out[i] for i in going], overall)
        left = []
        for i, m, ll in zip(going, after, now, strict=True):
            over = done == passes if passes is not None else abs(ll - lls[i]) < 1e-3 * total and len(m.weight) == len(out[i].weight)
            lls[i] = ll
            if not over:  # the log-likelihood is of the mixture before the step
                out[i] = m
                left.append(i)
        going, done = left, done + 1
    return out, lls, total


def fit(points: DataFrame, candidates: tuple[int, ...] = (8, 16, 32, 64, 96, 128), rough: bool = False) -> tuple[Reduction, Mixture] | None:
    """The reduction and the mixture of ``points(vec)``; None for an empty table.

    Starts: leaf entries of the reduced rows, joined by Ward linkage to each candidate number. All candidates step until
    none gains more than 1e-3 a row, and the lowest criterion wins; while that is the largest candidate's, larger ones
    are tried, from a tree of as many more entries, up to the distinct rows. ``rough``: no larger candidates, few steps and
    at most 24 axes, for centres that only have to be near the rows.
    """
    reduce = reduction(points, most=24 if rough else None)
    if reduce is None:
        return None
    sent = points.sparkSession.sparkContext.broadcast(reduce)

    def reduced(batches):
        for b in batches:
            x = vectors(b.column("vec"))
            yield pa.RecordBatch.from_arrays([lists(sent.value(x)) if len(x) else b.column("vec")], ["vec"])

    rows = points.select("vec").mapInArrow(reduced, "vec array<double>")
    tried: dict[int, tuple[float, float, Mixture]] = {}  # criterion, log-likelihood and mixture of each candidate
    most = max(512, 4 * max(candidates))
    while True:
        tree = leaf_entries(rows, 1e-3, 2e-3, most)
        n, ls = tree.column("n").to_numpy(), vectors(tree.column("ls"))
        centre = ls / n[:, None]
        overall = np.maximum((n @ centre**2 - n.sum() * (n @ centre / n.sum()) ** 2) / n.sum() + 1e-6, 1e-6)
        radius2 = np.maximum(tree.column("ss").to_numpy() / n - (centre**2).sum(1), 0)
        d = centre.shape[1]
        if sizes := sorted({min(k, len(n)) for k in candidates} - set(tried)):
            mixtures = [_start(n, centre, radius2 / d, k, overall) for k in sizes]
            mixtures, lls, total = _stepped(points, reduce, mixtures, overall, 4 if rough else None)
            for k, m, ll in zip(sizes, mixtures, lls, strict=True):
                tried[k] = ((2 * d + 1) * len(m.weight) * np.log(total) - 2 * ll, ll, m)
        best = min(tried, key=lambda k: tried[k][0])
        if rough or best < max(tried):
            break
        if len(n) > best:
            candidates = (3 * best // 2, 2 * best)
            most = max(most, 4 * max(candidates))
        elif most < n.sum() and radius2.max() > 2e-6:  # the tree had to join rows
            most *= 2
        else:
            break
    _, last, mixture = tried[best]
    for _ in range(4 if rough else 0):
        (better,), (ll,), _ = _em(points, reduce, [mixture], overall)
        mixture, gain, last = better, ll - last, ll
        if 0 < gain < 1e-4 * abs(ll):
            break
    return reduce, mixture


def memberships(points: DataFrame, model: tuple[Reduction, Mixture]) -> DataFrame:
    """``points`` with ``cluster`` (the likeliest component) and ``density`` (log density under the mixture)."""
    sent = points.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reduce, mixture = sent.value
        step = _step([mixture])
        for b in batches:
            x = vectors(b.column("vec"))
            cluster, density = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at in range(0, len(x), step):
                log = mixture.log_densities(reduce(x[at : at + step]))
                top = log.max(1)
                cluster[at : at + step] = log.argmax(1)
                density[at : at + step] = top + np.log(np.exp(log - top[:, None]).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(density)], [*b.schema.names, "cluster", "density"])

    fields = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(run, f"{fields}, cluster int, density double")


def clusters(points: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster, size, typical, annotation, annotation_size`` of ``points(sample, annotation, vec)``.

    ``typical`` are the members of highest density (ties to the smaller sample); ``annotation`` is the most frequent
    label, null where no member has one, ties to the smaller. An empty table gives no rows.
    """
    model = fit(points)
    if model is None:
        return points.sparkSession.createDataFrame([], "cluster int, size long, typical array<string>, annotation string, annotation_size long")
    own = written(memberships(points, model).select("sample", "annotation", "cluster", "density"))
    size = own.groupBy("cluster").agg(F.count("*").alias("size"))
    best = top_n(own, ["cluster"], [F.col("density").desc(), F.col("sample")], typical)
    best = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "sample"))), lambda x: x["sample"]).alias("typical"))
    labels = own.where("annotation is not null").groupBy("cluster", "annotation").agg(F.count("*").alias("annotation_size"))
    labels = top_n(labels, ["cluster"], [F.col("annotation_size").desc(), F.col("annotation")], 1).drop("rank_no")
    return size.join(best, "cluster").join(labels, "cluster", "left").select("cluster", "size", "typical", "annotation", "annotation_size")


def linked(points: DataFrame, distance: float) -> DataFrame:
    """``sample, first``: each row of ``points(sample, vec)`` with the smallest sample of its chain of links, rows at
    most ``distance`` apart being linked.

    The mixture divides the rows: a row belongs to its likeliest component, which its member of highest density represents,
    and members within ``distance`` of the representative are in one chain. Rows far from the representative belong to
    leaf entries of their own. The exact check (see ``balls``) joins components that a chain connects, and parts the members
    of one that none does.
    """
    model = fit(points, rough=True)  # the check is exact for any division
    if model is None:
        return points.sparkSession.createDataFrame([], "sample string, first string")
    own = memberships(points.select("sample", "vec"), model)
    best = top_n(own, ["cluster"], [F.col("density").desc(), F.col("sample")], 1).select("cluster", "vec").collect()
    number = np.full(len(model[1].weight), -1, np.int32)
    number[[r["cluster"] for r in best]] = np.arange(len(best))
    pivots = np.array([r["vec"] for r in best], float)
    sent = points.sparkSession.sparkContext.broadcast((number, pivots))

    def own_pivot(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, pivots = sent.value
        x, leaf = vectors(b.column("vec")), number[b.column("cluster").to_numpy()]
        return x, leaf, np.sqrt(((x - pivots[leaf]) ** 2).sum(1)) if len(x) else np.zeros(0)

    def far(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec").filter(pa.array(own_pivot(b)[2] > distance))], ["vec"])

    rest = leaf_entries(own.select("vec", "cluster").mapInArrow(far, "vec array<double>"), distance / 2, 0.75 * distance)
    entries = vectors(rest.column("ls")) / rest.column("n").to_numpy()[:, None] if len(rest) else np.zeros((0, pivots.shape[1]))
    more = points.sparkSession.sparkContext.broadcast(entries)

    def place(batches):
        for b in batches:
            x, leaf, rho = own_pivot(b)
            away = np.flatnonzero(rho > distance) if len(more.value) else []
            step = max(16, min(1024, PAIRS // max(len(more.value), 1)))
            for at in range(0, len(away), step):
                rows = away[at : at + step]
                to = distances(x[rows], more.value).argmin(1)
                leaf[rows], rho[rows] = len(sent.value[1]) + to, np.sqrt(((x[rows] - more.value[to]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("vec"), pa.array(leaf.astype(np.int32)), pa.array(rho)], ["sample", "vec", "leaf", "rho"])

    placed = own.select("sample", "vec", "cluster").mapInArrow(place, "sample string, vec array<double>, leaf int, rho double")
    return chains(points, np.vstack([pivots, entries]), distance, placed)
