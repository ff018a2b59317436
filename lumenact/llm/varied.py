"""Problem 1: a varied subset by cluster features and Ward linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balls import lonely
from .cftree import leaf_entries, ward
from .common import vectors

#: Entries aimed at at the root of the tree; Ward's table of twice as many has 64 MB.
MAX_ENTRIES = 2048


def varied_subset(points: DataFrame, size: int, label: str = "annotation", radius: float = 0.0, kind: float | None = None) -> DataFrame:
    """At most ``size`` rows of ``points(sample, vec, label)``: ``sample, label, grp, grp_size, distance``.

    The entries of every label agglomerate among themselves by Ward linkage until ``size`` groups are left in all
    (labels do not count when there are more labels than ``size``), and the row nearest each group's centre comes out,
    ties to the smaller sample. An entry counts once in the linkage, however many rows it stands for, so a crowded kind
    costs no more to merge than a sparse one and does not fill the subset. A null label is a label of its own. Rows no
    more than ``radius`` apart, by default equal ones, count as one kind; there are fewer rows than ``size`` only if there
    are fewer kinds. An empty table gives no rows.

    With ``kind``, rows farther than that from every chosen row, of any label, get places of their own, and the other
    entries are joined to so many groups less, until no such rows are left or all places but one a label are given.
    """
    spark = points.sparkSession
    if size < 1:
        raise ValueError("size must be positive")
    labels = points.select(label).distinct().count()
    by = (label,) if labels <= size else ()  # more labels than rows to choose: a label gives no place of its own
    labels = labels if by else 1
    most = max(16, 2 * max(MAX_ENTRIES, 2 * size) // max(labels, 1))  # of a label; Ward's table grows with all of them
    tree = _entries(points, radius, 1.5 * radius, most, by).sort_values(["key", "n"], ascending=[True, False])
    if not len(tree):
        return spark.createDataFrame([], f"sample string, {label} string, grp int, grp_size long, distance double")
    n, ls = tree["n"].to_numpy(), np.stack(tree["ls"].to_numpy())
    keys, owner, given = tree["key"].to_numpy(), np.full(len(n), -1), 0
    while True:
        chosen = _chosen(points, label, by, keys, n, ls, _grouped(keys, n, ls, owner, size - given))
        if kind is None or given >= size - labels:
            return chosen
        chosen = spark.createDataFrame(chosen.toArrow(), chosen.schema)  # at most ``size`` rows
        picks = points.join(chosen.select("sample").distinct(), "sample", "left_semi").select("vec").toArrow()
        far = _entries(_far(points, label, vectors(picks.column("vec")), kind), kind / 4, kind / 2, most, by).sort_values(["n", "key"], ascending=[False, True])
        taken: list[np.ndarray] = []
        for key, m, total in far.itertuples(index=False):
            at = np.asarray(total) / m
            if given == size - labels or any(((at - o) ** 2).sum() <= kind**2 for o in taken):
                continue  # one place for each kind
            taken.append(at)
            own = (keys == key) & (owner < 0) & (((ls / n[:, None] - at) ** 2).sum(1) <= (kind / 2) ** 2)
            owner[own] = given
            keys, n, ls, owner = np.append(keys, key), np.append(n, m), np.vstack([ls, total]), np.append(owner, given)
            given += 1
        if not taken:
            return chosen


def _entries(points: DataFrame, radius: float, reach: float, most: int, by: tuple[str, ...]) -> pd.DataFrame:
    return leaf_entries(points, radius, reach, most, by).select(["key", "n", "ls"]).to_pandas()


def _grouped(keys: np.ndarray, n: np.ndarray, ls: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The group of each entry: ``size`` groups by Ward linkage of those without an owner, and one for each owner."""
    free = owner < 0
    block = np.unique(keys[free], return_inverse=True)[1]
    group = np.empty(len(n), int)
    group[free] = ward(np.ones(free.sum()), ls[free] / n[free, None], size, block)
    group[~free] = owner[~free] + (group[free].max() + 1 if free.any() else 0)
    return group


def _far(points: DataFrame, label: str, picks: np.ndarray, distance: float) -> DataFrame:
    """``label, vec`` of the rows farther than ``distance`` from all ``picks``."""
    sent = points.sparkSession.sparkContext.broadcast(picks)

    def run(batches):
        for b in batches:
            x = vectors(b.column("vec"))
            if len(x):
                d = (x**2).sum(1)[:, None] + (sent.value**2).sum(1)[None] - 2 * x @ sent.value.T
                yield b.filter(pa.array(d.min(1) > distance**2))

    return points.select(label, "vec").mapInArrow(run, f"{label} string, vec array<double>")


def _chosen(points: DataFrame, label: str, by: tuple[str, ...], keys: np.ndarray, n: np.ndarray, ls: np.ndarray, group: np.ndarray) -> DataFrame:
    """The row nearest the centre of each group of entries; a row is in the group of the nearest entry of its label."""
    spark, centre = points.sparkSession, ls / n[:, None]
    k = group.max() + 1
    total = np.zeros(k)
    middle = np.zeros((k, ls.shape[1]))
    np.add.at(total, group, n)
    np.add.at(middle, group, ls)
    middle /= total[:, None]
    sent = spark.sparkContext.broadcast((keys, centre, group, middle))

    def nearest(batches):
        keys, centre, group, middle = sent.value
        own = {key: np.flatnonzero(keys == key) for key in np.unique(keys)}
        for b in batches:
            x, label_of = vectors(b.column("vec")), np.array([v or "" if by else "" for v in b.column(label).to_pylist()], object)
            grp, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for key in set(label_of):
                rows = np.flatnonzero(label_of == key)
                at = own[key]
                for s in range(0, len(rows), 1024):
                    r = rows[s : s + 1024]
                    d = (centre[at] ** 2).sum(1)[None] - 2 * x[r] @ centre[at].T
                    grp[r] = group[at[d.argmin(1)]]
            if len(x):
                dist = np.sqrt(((x - middle[grp]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column(label), pa.array(grp), pa.array(dist)], ["sample", label, "grp", "distance"])

    rows = points.select("sample", label, "vec").mapInArrow(nearest, f"sample string, {label} string, grp int, distance double")
    best = F.min(F.struct("distance", "sample", label))
    return rows.groupBy("grp").agg(best.alias("b"), F.count("*").alias("grp_size")).select("b.sample", f"b.{label}", "grp", "grp_size", "b.distance")


def sparse_points(points: DataFrame, distance: float, most: int, size: int = 200, label: str = "annotation") -> DataFrame:
    """``sample`` of every row of ``points(sample, vec, label)`` with at most ``most`` other rows within ``distance``.

    The rows of a varied subset of ``size``, each the nearest to the centre of a group of Ward's linkage, stand for their
    groups; leaf entries, of half the distance, stand for what is far from all of them. A row well inside a group of enough
    rows is settled by the group, and an exact check in blocks settles the rest (see ``balls``).
    """
    chosen = varied_subset(points, size, label, kind=distance).select("sample").distinct()
    picks = points.join(chosen, "sample", "left_semi").select("vec").distinct().toArrow()
    if not len(picks):
        return points.select("sample").limit(0)
    pivots = vectors(picks.column("vec"))
    tree = leaf_entries(_far(points, label, pivots, 0.75 * distance), distance / 2, 0.75 * distance, 2 * MAX_ENTRIES)
    if len(tree):
        pivots = np.vstack([pivots, vectors(tree.column("ls")) / tree.column("n").to_numpy()[:, None]])
    return lonely(points, pivots, distance, most)
