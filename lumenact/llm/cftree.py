"""Cluster features: summaries (count, linear sum, sum of squares) that merge by addition.

Each partition of the input condenses its rows into leaf entries, the summaries of partitions merge level by level,
and the entries left at the root, at most ``max_entries``, are small enough for the driver whatever the input's size.
Ward linkage then joins entries into groups without looking at rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lists, vectors

FAN_IN = 32
_ENTRY = "part long, n double, ls array<double>, ss double, key string"


class Entries:
    """Leaf entries of one node. An entry takes in another when the joint root-mean-square radius stays within
    ``radius`` and the centres are at most ``reach`` apart. When there would be more than ``most`` entries, both
    bounds grow, to about the distance of neighbouring entries, and the entries are inserted anew, as a
    cluster-feature tree is rebuilt."""

    def __init__(self, dim: int, radius: float, reach: float, most: int):
        self.dim, self.radius, self.reach, self.most = dim, radius, reach, most
        self.size = 0
        self.n, self.ls, self.ss = np.zeros(64), np.zeros((64, dim)), np.zeros(64)

    def _grow(self, k: int) -> None:
        while len(self.n) < self.size + k:
            self.n, self.ls, self.ss = (np.concatenate([a, np.zeros_like(a)]) for a in (self.n, self.ls, self.ss))

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        for at in range(0, len(n), 512):
            self._insert(n[at : at + 512], ls[at : at + 512], ss[at : at + 512])
            while self.size > self.most:
                self._rebuild()

    def _rebuild(self) -> None:
        n, ls, ss = self.n[: self.size].copy(), self.ls[: self.size].copy(), self.ss[: self.size].copy()
        centre = ls / n[:, None]
        some = np.linspace(0, self.size - 1, min(self.size, 256)).astype(int)
        d = (centre[some] ** 2).sum(1)[:, None] + (centre**2).sum(1)[None] - 2 * centre[some] @ centre.T
        d[np.arange(len(some)), some] = np.inf
        near = float(np.sqrt(max(np.median(d.min(1)), 0.0)))  # joins about half of the entries with their neighbours
        self.radius, self.reach = max(self.radius * 1.25, 0.55 * near, 1e-9), max(self.reach * 1.25, 1.1 * near, 2e-9)
        self.size = 0
        for at in range(0, len(n), 512):
            self._insert(n[at : at + 512], ls[at : at + 512], ss[at : at + 512])

    def _insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        left = np.arange(len(n))
        if self.size:
            left = left[~self._absorb(n, ls, ss, 0)]
        while len(left):  # the first that fits nowhere opens an entry, and the rest try that one
            self._grow(1)
            i, k = left[0], self.size
            self.size, left = k + 1, left[1:]
            self.n[k], self.ls[k], self.ss[k] = n[i], ls[i], ss[i]
            if len(left):
                left = left[~self._absorb(n[left], ls[left], ss[left], k)]

    def _absorb(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, first: int) -> np.ndarray:
        centre, mine = ls / n[:, None], self.ls[first : self.size] / self.n[first : self.size, None]
        d2 = (centre**2).sum(1)[:, None] + (mine**2).sum(1)[None] - 2 * centre @ mine.T
        to = d2.argmin(1)
        near = np.maximum(d2[np.arange(len(n)), to], 0)
        own, to = mine[to], to + first
        joint_n = n + self.n[to]
        # the radius after joining, from the two summaries and the distance of their centres
        inner = np.maximum(ss - n * (centre**2).sum(1), 0) + np.maximum(self.ss[to] - self.n[to] * (own**2).sum(1), 0)
        radius2 = (inner + n * self.n[to] / joint_n * near) / joint_n
        ok = (radius2 <= self.radius**2) & (near <= self.reach**2)
        np.add.at(self.n, to[ok], n[ok])
        np.add.at(self.ls, to[ok], ls[ok])
        np.add.at(self.ss, to[ok], ss[ok])
        return ok

    def frame(self, part: int, key: str) -> pa.Table:
        k = self.size
        own = [np.full(k, part, np.int64), self.n[:k], lists(self.ls[:k]), self.ss[:k], pa.array([key] * k, pa.string())]
        return pa.table(own, names=["part", "n", "ls", "ss", "key"])


def leaf_entries(points: DataFrame, radius: float, reach: float, most: int = 2048, keys: tuple[str, ...] = ()) -> pa.Table:
    """Leaf entries of all rows of ``points(vec, ...)``, at most ``most`` (of each combination of ``keys``) at the root, which
    the driver gets: ``keys`` must have a bounded number of values.

    Two passes of Arrow batches; a task holds its entries only, never its rows.
    """

    def condense(batches):
        part, trees = TaskContext.get().partitionId(), {}
        for b in batches:
            x = vectors(b.column("vec"))
            groups = pd.DataFrame({k: b.column(k).to_pandas() for k in keys}).fillna("").astype(str).agg("\x1f".join, axis=1).to_numpy() if keys and len(x) else np.zeros(len(x), "U1")
            for g in np.unique(groups):
                own = x[groups == g]
                tree = trees.setdefault(g, Entries(x.shape[1], radius, reach, most))
                tree.insert(np.ones(len(own)), own, (own**2).sum(1))
        for g, tree in trees.items():
            yield from tree.frame(part, str(g)).to_batches()

    def merge(key, t):
        ls = vectors(t.column("ls"))
        order = np.argsort(-t.column("n").to_numpy(), kind="stable")
        tree = Entries(ls.shape[1], radius, reach, most)
        tree.insert(t.column("n").to_numpy()[order], ls[order], t.column("ss").to_numpy()[order])
        return tree.frame(key[0].as_py(), key[1].as_py())

    first = level = kept(points.select(*keys, "vec").mapInArrow(condense, _ENTRY))
    parts = level.agg(F.max("part")).first()[0]
    while parts is not None:
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "key").applyInArrow(merge, _ENTRY)
        if (parts := parts // FAN_IN) == 0:
            break
    root = level.toArrow()
    first.unpersist()
    return root


def ward(n: np.ndarray, centre: np.ndarray, k: int, block: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..k-1 of entries agglomerated by Ward linkage down to ``k`` groups.

    ``block``: entries of different blocks join only when every block has become one group. Ties go to the earlier entry.
    Quadratic in the entries, whose number is bounded.
    """
    n, centre = np.asarray(n, float), np.asarray(centre, float)
    block = np.zeros(len(n), int) if block is None else np.asarray(block)
    label = _joined(n, centre, k, block)
    if len(np.unique(label)) > k:
        total = np.bincount(label, n)
        middle = np.zeros((len(total), centre.shape[1]))
        np.add.at(middle, label, n[:, None] * centre)
        label = _joined(total, middle / total[:, None], k, np.zeros(len(total), int))[label]
    return label


def _joined(n: np.ndarray, centre: np.ndarray, k: int, block: np.ndarray) -> np.ndarray:
    """Labels after joining within blocks down to ``k`` groups, or one a block; the costs of a joint group follow from those
    of its two parts."""
    m = len(n)
    n, label, alive = n.copy(), np.arange(m), np.ones(m, bool)
    cost = np.empty((m, m), np.float32)
    square = (centre**2).sum(1)
    for at in range(0, m, 512):
        rows = slice(at, at + 512)
        d2 = np.maximum(square[rows, None] + square[None] - 2 * centre[rows] @ centre.T, 0)
        cost[rows] = np.where(block[rows, None] == block[None], n[rows, None] * n[None] / np.maximum(n[rows, None] + n[None], 1e-300) * d2, np.inf)
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(1) if m else label
    best = cost[np.arange(m), near]
    for _ in range(m - k):
        i = int(best.argmin())
        if not np.isfinite(best[i]):
            break
        i, j = sorted((i, int(near[i])))
        total = n[i] + n[j] + n
        both = ((n[i] + n) * cost[i].astype(float) + (n[j] + n) * cost[j].astype(float) - n * float(cost[i, j])) / total
        both[~alive], both[i], both[j] = np.inf, np.inf, np.inf
        n[i], alive[j] = n[i] + n[j], False
        label[label == j] = i
        cost[j, :] = cost[:, j] = np.inf
        best[j] = np.inf
        cost[i, :] = cost[:, i] = both
        for r in np.flatnonzero(alive & ((near == i) | (near == j))):
            near[r] = cost[r].argmin()
            best[r] = cost[r, near[r]]
        closer = alive & (cost[:, i] < best)
        near[closer], best[closer] = i, cost[closer, i]
    return np.unique(label, return_inverse=True)[1]
