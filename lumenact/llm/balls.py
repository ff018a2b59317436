"""Exact questions about points within a distance, answered through pivots.

Every point belongs to its nearest pivot at a distance ``rho``. By the triangle inequality two members of one pivot are
within ``rho_x + rho_y``, and a point ``x`` at distance ``d`` of a pivot of covering radius ``R`` has no member within
``t`` when ``d - R > t``. Most answers follow from these bounds; only the others are compared, in bounded blocks.
The number of pivots is bounded, so the pivots and their statistics may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, vectors, written

#: Rows of one block of a comparison, on either side.
BLOCK = 8192
#: Distances that a task holds at once, and rows of a batch that it sends.
PAIRS, ROWS = 1 << 19, 4096
#: Slack for rounding of distances; what lies inside it is compared exactly.
EPS = 1e-6


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def within(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Which pairs are within ``t``; those near the limit are summed anew without cancellation."""
    d = distances(x, y)
    hit = d <= t
    for i, j in zip(*np.nonzero(np.abs(d - t) < EPS * max(1.0, t)), strict=True):
        hit[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum()) <= t
    return hit


def assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``sample, vec`` with ``leaf`` (the nearest pivot, ties to the smaller number) and ``rho``."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    def near(batches):
        for b in batches:
            x = vectors(b.column("vec"))
            leaf, rho = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at in range(0, len(x), 1024):
                d = distances(x[at : at + 1024], sent.value)
                leaf[at : at + 1024] = d.argmin(1)
            if len(x):
                rho = np.sqrt(((x - sent.value[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(rho)], [*b.schema.names, "leaf", "rho"])

    fields = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(near, f"{fields}, leaf int, rho double")


def leaf_stats(assigned: DataFrame, m: int, pivots: int, where=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pivot: its members, its covering radius and the ``m``-th smallest ``rho`` (infinite if there are fewer)."""
    rows = assigned if where is None else assigned.where(where)
    n, cover, inner = np.zeros(pivots), np.full(pivots, -np.inf), np.full(pivots, np.inf)
    for r in rows.groupBy("leaf").agg(F.count("*").alias("n"), F.max("rho").alias("r")).collect():
        n[r["leaf"]], cover[r["leaf"]] = r["n"], r["r"]
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy("rho"))
    for r in rows.select("leaf", "rho").withColumn("k", rank).where(F.col("k") <= m).where(F.col("k") == m).collect():
        inner[r["leaf"]] = r["rho"]
    return n, cover, inner


def compare(queries: DataFrame, members: DataFrame, per_leaf: np.ndarray, queries_per_leaf: np.ndarray, fn, schema: str) -> DataFrame:
    """``fn(query table, member table)`` over every pair of blocks that share a leaf.

    Both sides are split by a hash into blocks of about ``BLOCK`` rows, so a leaf of any size is no single task's load.
    """
    spark = queries.sparkSession
    sizes = spark.createDataFrame(
        [(int(i), int(max(1, -(-per_leaf[i] // BLOCK))), int(max(1, -(-queries_per_leaf[i] // BLOCK)))) for i in np.flatnonzero(queries_per_leaf)] or [(-1, 1, 1)],
        "leaf int, nb int, nq int",
    )
    q = queries.join(F.broadcast(sizes), "leaf")
    q = q.withColumn("q", F.pmod(F.xxhash64("sample"), F.col("nq")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq")
    m = members.join(F.broadcast(sizes), "leaf")
    m = m.withColumn("b", F.pmod(F.xxhash64("sample"), F.col("nb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nb", "nq")
    keys = ["leaf", "b", "q"]
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(fn, schema)


def reach(rows: DataFrame, pivots: np.ndarray, bound, schema: str) -> DataFrame:
    """``bound(batch table, distances to all pivots)`` gives the record batches of the leaves a point must ask; it gets so many
    rows at once that their distances are about ``PAIRS`` at most."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            step = max(16, min(1024, PAIRS // max(len(sent.value), 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield from bound(part, distances(vectors(part.column("vec")), sent.value))

    return rows.mapInArrow(run, schema)


def lonely(points: DataFrame, pivots: np.ndarray, t: float, most: int) -> DataFrame:
    """The samples of ``points(sample, vec)`` with at most ``most`` others within ``t``; exact for any pivots."""
    spark = points.sparkSession
    if not len(pivots):
        return points.select("sample").limit(0)
    need = most + 1
    assigned = written(assign(points.select("sample", "vec"), pivots))
    n, cover, inner = leaf_stats(assigned, need + 1, len(pivots))
    stats = spark.sparkContext.broadcast((cover, inner))

    def doubtful(batch: pa.RecordBatch, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        cover, inner = stats.value
        rho, leaf = batch.column("rho").to_numpy(), batch.column("leaf").to_numpy()
        sure = rho + inner[leaf] <= t - EPS  # its leaf alone holds enough neighbours
        sure |= (d + inner[None] <= t - EPS).any(1)
        i, j = np.nonzero(~sure[:, None] & (d - cover[None] <= t + EPS))
        for at in range(0, len(i), ROWS):
            part = batch.take(pa.array(i[at : at + ROWS]))
            yield pa.RecordBatch.from_arrays([part.column("sample"), part.column("vec"), pa.array(j[at : at + ROWS].astype(np.int32))], ["sample", "vec", "leaf"])

    asks = kept(reach(assigned, pivots, doubtful, "sample string, vec array<double>, leaf int"))
    asked = np.zeros(len(pivots))
    for r in asks.groupBy("leaf").count().collect():
        asked[r["leaf"]] = r["count"]

    def count(q, m):
        out = np.zeros(q.num_rows, np.int64)
        if q.num_rows and m.num_rows:
            x, y = vectors(q.column("vec")), vectors(m.column("vec"))
            for at in range(0, len(x), 512):
                out[at : at + 512] = within(x[at : at + 512], y, t).sum(1)
        return pa.table([q.column("sample").combine_chunks(), pa.array(out)], names=["sample", "n"])

    found = compare(asks, assigned.select("sample", "vec", "leaf"), n, asked, count, "sample string, n long")
    few = written(found.groupBy("sample").agg(F.sum("n").alias("n")).where(F.col("n") <= need).select("sample"))  # it is within t of itself
    asks.unpersist()
    return few


def _roots(vec: np.ndarray, t: float) -> np.ndarray:
    """The smallest pivot that a chain of links between the innermost members reaches from each pivot."""
    root = np.arange(len(vec))
    for at in range(0, len(vec), 512):
        for i, j in zip(*np.nonzero(distances(vec[at : at + 512], vec) <= t - EPS), strict=True):
            a, b = at + i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    while (root != root[root]).any():
        root = root[root]
    return root


def _forest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the nodes ``a`` of the rows ``x`` with the nodes ``b`` of ``y`` that connect what all links within ``t`` connect.

    They are fewer than the nodes, where all links may be as many as the pairs of rows."""
    root = np.arange(max(a.max(), b.max()) + 1)
    first, second = [np.zeros(0, int)], [np.zeros(0, int)]
    step = max(16, PAIRS // len(y))
    for at in range(0, len(x), step):
        i, j = np.nonzero(within(x[at : at + step], y, t))
        u, v = a[at + i], b[j]
        while (apart := root[u] != root[v]).any():
            u, v = u[apart], v[apart]
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            order = np.lexsort((low, high))
            pick = order[np.unique(high[order], return_index=True)[1]]  # each root goes to the smallest it is linked to
            root[high[pick]] = low[pick]
            first.append(u[pick])
            second.append(v[pick])
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate(first), np.concatenate(second)


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of the component of every node of ``edges(a, b)`` that is not that one itself.

    Alternating large and small stars; each round is written, and the rounds grow with the logarithm of the nodes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    now = written(both.where("a > b").distinct())
    seen = None
    while True:
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = mark


def chains(points: DataFrame, pivots: np.ndarray, t: float, placed: DataFrame | None = None) -> DataFrame:
    """``sample, first``: the smallest sample of the component of each of ``points(sample, vec)``, rows at most ``t``
    apart being linked; exact for any pivots. ``placed(sample, vec, leaf, rho)`` gives the pivot of each row, and its
    distance from it, by default the nearest pivot.

    A row near enough to the innermost member of its pivot is linked to it and belongs to the pivot's node. Other rows
    are nodes of their own. Only pairs of nodes not yet joined, and not kept apart by the bounds, are compared.
    """
    spark = points.sparkSession
    assigned = written(assign(points.select("sample", "vec"), pivots) if placed is None else placed)
    k = len(pivots)
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy("rho", "sample"))
    first = assigned.withColumn("k", rank).where("k = 1").select("leaf", "rho", "vec").collect()
    inner, middle = np.full(k, np.inf), pivots.copy()
    for r in first:
        inner[r["leaf"]], middle[r["leaf"]] = r["rho"], np.array(r["vec"])
    root = np.arange(k)
    real = np.flatnonzero(np.isfinite(inner))
    root[real] = real[_roots(middle[real], t)]
    n, cover = np.zeros(k), np.full(k, -np.inf)
    sure_cover = np.full(k, -np.inf)
    limits = spark.createDataFrame([(int(i), float(t - EPS - inner[i])) for i in real] or [(-1, 0.0)], "leaf int, most double")
    per = assigned.join(F.broadcast(limits), "leaf").groupBy("leaf").agg(F.count("*").alias("n"), F.max("rho").alias("r"), F.max(F.when(F.col("rho") <= F.col("most"), F.col("rho"))).alias("s"))
    for r in per.collect():
        n[r["leaf"]], cover[r["leaf"]] = r["n"], r["r"]
        if r["s"] is not None:
            sure_cover[r["leaf"]] = r["s"]
    sent = spark.sparkContext.broadcast((inner, root, cover, sure_cover))

    def nodes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        inner, root, _, _ = sent.value
        leaf, rho = batch.column("leaf").to_numpy(), batch.column("rho").to_numpy()
        sure = rho <= t - EPS - inner[leaf]
        return sure, np.where(sure, [f"r{root[i]}" for i in leaf], [f"p{s}" for s in batch.column("sample").to_pylist()]).astype(object)

    def asks(batch: pa.RecordBatch, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        inner, root, cover, sure_cover = sent.value
        leaf = batch.column("leaf").to_numpy()
        sure, node = nodes(batch)
        apart = root[leaf][:, None] != root[None]
        reached = np.where(sure[:, None], apart & (d <= t + EPS + sure_cover[None]), d <= t + EPS + cover[None])
        direct = (d + inner[None] <= t - EPS) & (apart | ~sure[:, None])
        i, j = np.nonzero(reached & ~(direct & sure[:, None]))
        di, dj = np.nonzero(direct)
        whose, leaves, linked = np.append(i, di), np.append(j, np.full(len(di), -1)).astype(np.int32), np.append(np.full(len(i), -1), root[dj])
        for at in range(0, len(whose), ROWS):
            own, to = whose[at : at + ROWS], linked[at : at + ROWS]
            rows, other = batch.take(pa.array(own)), [f"r{x}" if x >= 0 else None for x in to]
            yield pa.RecordBatch.from_arrays([rows.column("sample"), rows.column("vec"), pa.array(leaves[at : at + ROWS]), pa.array(node[own], pa.string()), pa.array(other, pa.string())], ["sample", "vec", "leaf", "node", "other"])

    asked = kept(reach(assigned, pivots, asks, "sample string, vec array<double>, leaf int, node string, other string"))
    per_leaf = np.zeros(k)
    for r in asked.where("leaf >= 0").groupBy("leaf").count().collect():
        per_leaf[r["leaf"]] = r["count"]

    def with_node(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes(b)[1], pa.string())], [*b.schema.names, "node"])

    placed = assigned.mapInArrow(with_node, "sample string, vec array<double>, leaf int, rho double, node string")

    def links(q, m):
        names, a, b = pa.array([], pa.string()), np.zeros(0, int), np.zeros(0, int)
        if q.num_rows and m.num_rows:
            every = pa.chunked_array([*q.column("node").chunks, *m.column("node").chunks], pa.string()).combine_chunks().dictionary_encode()
            names, code = every.dictionary, every.indices.to_numpy()
            a, b = _forest(vectors(q.column("vec")), vectors(m.column("vec")), code[: q.num_rows], code[q.num_rows :], t)
        return pa.table([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])

    direct = asked.where("leaf < 0").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    queries = asked.where("leaf >= 0").select("sample", "vec", "leaf", "node")
    found = compare(queries, placed.select("sample", "vec", "leaf", "node"), n, per_leaf, links, "a string, b string")
    edges = written(direct.unionByName(found).where("a <> b").distinct())
    asked.unpersist()
    mine = placed.groupBy("node").agg(F.min("sample").alias("least"))
    if not edges.isEmpty():
        joined = mine.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mine = joined.select("node", "label").join(joined.groupBy("label").agg(F.min("least").alias("least")), "label").select("node", "least")
    return placed.select("sample", "node").join(mine, "node").select("sample", F.col("least").alias("first"))
