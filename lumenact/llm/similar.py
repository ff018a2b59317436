"""Problem 5: the most similar vectors of every vector, by score-aware quantisation.

Vectors are scaled to length 1 and put into lists by their nearest coarse centre; where more than ``LEAVES`` lists are
needed, further levels of centres, shared by all lists, divide what is left of the vectors. What a vector differs by from the
nearest of a finer set of centres is quantised to four bits for every two dimensions. The codes are chosen for inner
products: an error along the vector costs ``ETA`` times what an error across it costs, as it is the former that moves
the scores of close vectors.

A scan adds table entries: of every query 16 products with a code book for each pair of dimensions, and one for every
fine centre, all rounded down to whole steps. Two codes share a byte, so the tables of two books are added up first and a
scan makes one look-up a byte. The best are scored again exactly.

With the parallel error ``<x, r>`` kept beside the code, a score is wrong by at most ``|q - x| |r|`` and the rounding. A
search for all pairs above a cosine uses this bound, and the triangle inequality for the lists to ask, so it loses none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, vectors, written
from .topn import top_n

ETA = 4.0
#: The index (centres and code books) is fitted on about so many vectors, those of the smallest hashes, and on at least
#: ``FIT_OF_LIST`` for each centre of a level; every vector is indexed.
FIT_ROWS = 8192
FIT_OF_LIST = 16
#: Fine centres.
FINE = 512
#: Vectors aimed at in a list, centres of one level at most, and rows of one block of a scan.
LIST_ROWS = 1000
LEAVES = 4096
BLOCK = 4096
#: Vectors whose true neighbours decide how many lists are asked.
TRIALS = 256


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        to = _closest(x, centre)
        n = np.bincount(to, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, to, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        if spherical:
            centre = unit(centre)
    return centre


def _closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    square = (centre**2).sum(1)[None]
    return np.concatenate([np.zeros(0, int), *[(square - 2 * x[a : a + 4096] @ centre.T).argmin(1) for a in range(0, len(x), 4096)]])


class Index:
    """Centres of the lists by level, fine centres (of the codes) and code books; ``books[m]`` holds the 16 entries of
    the ``m``-th pair of dimensions. A list's number has a digit for every level."""

    def __init__(self, sample: np.ndarray, n_lists: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.levels: list[np.ndarray] = []
        rest, need = sample, n_lists
        while need > 1 or not self.levels:
            k = min(need, LEAVES, len(sample))
            self.levels.append(_kmeans(rest, k, 8, rng, spherical=not self.levels))
            if k < 2:
                break
            rest = rest - self.levels[-1][_closest(rest, self.levels[-1])]
            need = -(-need // k)
        self.fine = _kmeans(sample, max(1, min(FINE, len(sample) // 12)), 6, rng, spherical=False)
        left = self._pad(sample - self.fine[_closest(sample, self.fine)])
        pairs = left.shape[1] // 2
        self.books = np.zeros((pairs, 16, 2))
        fit = left[:8192]
        for m in range(pairs):
            own = np.unique(fit[:, 2 * m : 2 * m + 2], axis=0)
            if len(own) > 16:
                own = _kmeans(own, 16, 6, rng, spherical=False)
            self.books[m, : len(own)] = own
            self.books[m, len(own) :] = own[0]
        for _ in range(2):  # refit the entries to what the score-aware codes put on them
            x = sample[: len(fit)]
            codes = self.encode(x)[0]
            for m in range(pairs):
                n = np.bincount(codes[:, m], minlength=16)
                total = np.zeros((16, 2))
                np.add.at(total, codes[:, m], fit[:, 2 * m : 2 * m + 2])
                self.books[m][n > 0] = (total / np.maximum(n, 1)[:, None])[n > 0]

    @staticmethod
    def _pad(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) if x.shape[1] % 2 else x

    # --- lists

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The list of every vector: level by level the centre nearest to what is left of it."""
        number, rest = np.zeros(len(x), np.int64), x
        for centre in self.levels:
            to = _closest(rest, centre)
            number, rest = number * len(centre) + to, rest - centre[to]
        return number

    def _descend(self, q: np.ndarray, first: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the lists they ask, from the marks of the first level; ``choose(queries, squared distances)`` marks
        the centres of a further level."""
        i, number = np.nonzero(first)
        rest = q[i] - self.levels[0][number]
        for centre in self.levels[1:]:
            d2 = np.maximum((rest**2).sum(1)[:, None] + (centre**2).sum(1)[None] - 2 * rest @ centre.T, 0)
            at, to = np.nonzero(choose(i, d2))
            i, number, rest = i[at], number[at] * len(centre) + to, rest[at] - centre[to]
        return i, number

    def holding(self, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Every list that can hold a vector of at least this cosine with the query.

        A partner's centre is the nearest to the partner, and the query is near the partner: so the query is farther from that
        centre than from its own nearest one by at most twice their distance, on every level.
        """
        angle, reach = float(np.arccos(np.clip(cosine, -1, 1))) + 1e-6, float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
        theta = np.arccos(np.clip(q @ self.levels[0].T, -1, 1))
        first = theta <= theta.min(1, keepdims=True) + 2 * angle

        def choose(_, d2):
            d = np.sqrt(d2)
            return d <= d.min(1, keepdims=True) + 2 * reach

        return self._descend(q, first, choose)

    def nearby(self, q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` lists of the nearest centres (all if there are fewer)."""
        products = q @ self.levels[0].T
        most = min(probes, products.shape[1])
        first = np.zeros(products.shape, bool)
        np.put_along_axis(first, np.argpartition(-products, most - 1, axis=1)[:, :most], True, axis=1)

        def choose(i, d2):
            order = np.lexsort((d2.ravel(), np.repeat(i, d2.shape[1])))
            n = np.bincount(i, minlength=len(q)) * d2.shape[1]
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            mark = np.zeros(d2.size, bool)
            mark[order[rank < probes]] = True
            return mark.reshape(d2.shape)

        return self._descend(q, first, choose)

    # --- codes

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, fine centres, the parallel errors ``<x, x - decoded>`` and the lengths of the errors.

        Starting from the nearest entries, each code in turn moves to the entry of the least score-aware loss
        ``|r|^2 + (ETA - 1) <x, r>^2``.
        """
        of = _closest(x, self.fine)
        left, along = self._pad(x - self.fine[of]), self._pad(x)
        pairs = len(self.books)
        parts = left.reshape(len(x), pairs, 2)
        directions = along.reshape(len(x), pairs, 2)
        codes = np.zeros((len(x), pairs), np.uint8)
        errors = np.empty_like(parts)
        for m in range(pairs):
            d = ((parts[:, m, None, :] - self.books[m][None]) ** 2).sum(2)
            codes[:, m] = d.argmin(1)
            errors[:, m] = parts[:, m] - self.books[m][codes[:, m]]
        parallel = (errors * directions).sum((1, 2))
        for m in range(pairs):
            option = parts[:, m, None, :] - self.books[m][None]
            now = (errors[:, m] * directions[:, m]).sum(1)
            moved = parallel[:, None] - now[:, None] + (option * directions[:, m, None, :]).sum(2)
            best = ((option**2).sum(2) + (ETA - 1) * moved**2).argmin(1)
            codes[:, m], errors[:, m] = best, option[np.arange(len(x)), best]
            parallel = moved[np.arange(len(x)), best]
        return codes, of, parallel, np.sqrt((errors**2).sum((1, 2)))

    def tables(self, q: np.ndarray) -> Tables:
        return Tables(self, q)


class Tables:
    """The look-up tables of some queries: ``zero + step * (fine[base] + sum of books[byte])`` is a score, too small by
    less than ``slack``."""

    def __init__(self, index: Index, q: np.ndarray):
        pairs = len(index.books)
        parts = np.ascontiguousarray(index._pad(q).reshape(len(q), pairs, 2))
        entry = np.einsum("qmd,mcd->mcq", parts, index.books)
        low = entry.min(1)
        entry -= low[:, None]
        fine = index.fine @ q.T + low.sum(0)[None]
        self.zero = float(fine.min())
        self.step = max(float((fine.max(0) + entry.max(1).sum(0)).max() - self.zero), 1e-9) / 60000
        self.slack = (pairs + 2) * self.step
        self.fine = np.floor((fine - self.zero) / self.step).astype(np.uint16)
        small = np.floor(entry / self.step).astype(np.uint16)
        if pairs % 2:
            small = np.concatenate([small, np.zeros_like(small[:1])])
        # a byte's high half is the second code
        self.books = (small[1::2, :, None] + small[0::2, None]).reshape(len(small) // 2, 256, len(q))

    def scan(self, codes: np.ndarray, base: np.ndarray, rows: int = 256):
        """``first row, steps of the scores (row, query)`` of ``rows`` members at a time."""
        part = np.empty((rows, self.fine.shape[1]), np.uint16)
        for at in range(0, len(codes), rows):
            some = codes[at : at + rows]
            total, more = self.fine[base[at : at + rows]], part[: len(some)]
            for m, table in enumerate(self.books):
                np.take(table, some[:, m], axis=0, out=more, mode="clip")
                total += more
            yield at, total


def _packed(codes: np.ndarray) -> pa.Array:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    both = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
    n, w = both.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * w), pa.py_buffer(np.ascontiguousarray(both))])


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def build(points: DataFrame) -> Index | None:
    """An index fitted to a bounded sample of ``points(sample, vec)``; None without rows."""
    n = points.count()
    n_lists = max(1, n // LIST_ROWS)
    fit = max(FIT_ROWS, FIT_OF_LIST * min(n_lists, LEAVES))
    share = F.pmod(F.xxhash64("sample"), F.lit(1 << 30)) < int(min(1.0, fit / max(n, 1)) * (1 << 30))
    rows = points.where(share).select("vec").toArrow()
    if n and not len(rows):  # very few rows
        rows = points.limit(fit).select("vec").toArrow()
    return Index(unit(vectors(rows.column("vec"))), n_lists) if len(rows) else None


_MEMBER = "sample string, x array<float>, leaf long, base int, code binary, parallel double, error double"


def members(points: DataFrame, index: Index) -> DataFrame:
    """Every row with its list and codes."""
    sent = points.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = unit(vectors(part.column("vec"))).astype(np.float32).astype(float)
                codes, base, parallel, error = index.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("sample"), lists(x.astype(np.float32)), pa.array(index.leaf(x)), pa.array(base.astype(np.int32)), _packed(codes), pa.array(parallel), pa.array(error)],
                    ["sample", "x", "leaf", "base", "code", "parallel", "error"],
                )

    return points.select("sample", "vec").mapInArrow(run, _MEMBER)


def _asks(own: DataFrame, index: Index, pick) -> DataFrame:
    """``sample, x, ask``: each row once for every list that ``pick(index, vectors)`` names."""
    sent = own.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                i, j = pick(sent.value, vectors(part.column("x")))
                rows = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([rows.column("sample"), rows.column("x"), pa.array(j.astype(np.int64))], ["sample", "x", "ask"])

    return own.select("sample", "x").mapInArrow(run, "sample string, x array<float>, ask long")


def _scan(asks: DataFrame, own: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(queries, members)`` over blocks of the queries and members of every list."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    asked = asks.groupBy(F.col("ask").alias("leaf")).agg(F.count("*").alias("asked"))
    splits = own.groupBy("leaf").agg(F.count("*").alias("held")).join(asked, "leaf").select("leaf", blocks("held").alias("nb"), blocks("asked").alias("nq"))
    splits = written(splits)
    part = lambda n: F.pmod(F.xxhash64("sample"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asks.withColumnRenamed("ask", "leaf").join(splits, "leaf").withColumn("q", part("nq")).withColumn("b", every("nb")).drop("nb", "nq")
    m = own.join(splits, "leaf").withColumn("b", part("nb")).withColumn("q", every("nq")).drop("nb", "nq")
    return q.groupBy("leaf", "b", "q").cogroup(m.groupBy("leaf", "b", "q")).applyInArrow(fn, schema)


def similar_classes(points: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: all pairs of different vectors of ``points(sample, vec)`` with at least this cosine, each named by its
    smallest sample (``a < b``); and ``(rep, sample)``: the smallest sample that has the vector of each one.

    Equal vectors are searched once. A zero vector has no cosine, no pair and no class. Complete for any data: a list is
    asked if it can hold a partner, and a code is scored exactly if its score, mended by the kept parallel error, can reach
    the cosine.
    """
    spark = points.sparkSession
    points = points.select("sample", "vec").where(F.exists("vec", lambda v: v != 0))
    # only vectors that occur again need the join, with one row for each of them
    again = points.groupBy("vec").agg(F.min("sample").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = written(points.join(again, "vec", "left").select(F.coalesce("rep", "sample").alias("rep"), "sample", "vec"))
    reps, groups = copies.where("sample = rep").select("sample", "vec").dropDuplicates(["sample"]), copies.select("rep", "sample")
    index = build(reps)
    if index is None:
        return spark.createDataFrame([], "a string, b string"), groups
    own = written(members(reps, index))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6  # the distance of two unit vectors of that cosine
    sent = spark.sparkContext.broadcast(index)

    def block(left, right):
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            q, x = vectors(left.column("x"), np.float32), vectors(right.column("x"), np.float32)
            codes, base = _bytes(right.column("code")), right.column("base").to_numpy()
            floor = cosine - reach * right.column("error").to_numpy() - right.column("parallel").to_numpy() - 2e-5
            qs, xs = np.array(left.column("sample").to_pylist(), object), np.array(right.column("sample").to_pylist(), object)
            for at in range(0, len(q), 512):
                tables = sent.value.tables(q[at : at + 512].astype(float))
                least = np.clip(np.floor((floor - tables.slack - tables.zero) / tables.step), 0, 65535).astype(np.uint16)
                for first, score in tables.scan(codes, base):
                    j, i = np.nonzero(score >= least[first : first + len(score), None])
                    i, j = i + at, j + first
                    exact = np.einsum("ij,ij->i", q[i], x[j])
                    keep = (exact >= cosine - 1e-5) & (qs[i] < xs[j])  # the last word is the double values'
                    out_a += qs[i[keep]].tolist()
                    out_b += xs[j[keep]].tolist()
        return pa.table([pa.array(out_a, pa.string()), pa.array(out_b, pa.string())], names=["a", "b"])

    close = _scan(_asks(own, index, lambda index, q: index.holding(q, cosine)), own, block, "a string, b string").distinct()
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    v1, v2 = F.col("va"), F.col("vb")
    dot = F.aggregate(F.zip_with(v1, v2, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    close = close.join(reps.select(F.col("sample").alias("a"), F.col("vec").alias("va")), "a").join(reps.select(F.col("sample").alias("b"), F.col("vec").alias("vb")), "b")
    return close.where(dot / norm(v1) / norm(v2) >= cosine).select("a", "b"), groups


def similar_pairs(points: DataFrame, cosine: float) -> DataFrame:
    """``sample_a, sample_b``: all pairs of ``points(sample, vec)`` with at least this cosine, ``sample_a < sample_b``: the
    pairs of ``similar_classes`` with all copies. The copies of one vector meet in blocks, so many are no single task's load.
    """
    close, groups = similar_classes(points, cosine)
    a, b = groups.select(F.col("rep").alias("a"), F.col("sample").alias("sa")), groups.select(F.col("rep").alias("b"), F.col("sample").alias("sb"))
    across = close.join(a, "a").join(b, "b").select("sa", "sb")
    many = groups.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = groups.join(many, "rep").withColumn("own", F.pmod(F.xxhash64("sample"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = many.select("rep", F.col("sample").alias("sa"), F.col("own").alias("i"), every.alias("j"))
    right = many.select("rep", F.col("sample").alias("sb"), F.col("own").alias("j"), every.alias("i"))
    both = across.unionByName(left.join(right, ["rep", "i", "j"]).where("sa < sb").select("sa", "sb"))
    return both.select(F.least("sa", "sb").alias("sample_a"), F.greatest("sa", "sb").alias("sample_b"))


def _exact(queries: np.ndarray, names: list[str], own: DataFrame, k: int) -> list[tuple[int, int]]:
    """``query, list`` of the true ``k`` nearest of a few queries, by a scan of all rows; not of the query itself."""
    sent = own.sparkSession.sparkContext.broadcast((queries.astype(np.float32), names))

    def run(batches):
        queries, names = sent.value
        for b in batches:
            score = queries @ vectors(b.column("x"), np.float32).T
            at = {s: i for i, s in enumerate(b.column("sample").to_pylist())}
            for i, name in enumerate(names):
                if name in at:
                    score[i, at[name]] = -9
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(queries), dtype=np.int32), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i), b.column("leaf").take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], ["q", "leaf", "cosine"])

    found = own.select("sample", "x", "leaf").mapInArrow(run, "q int, leaf long, cosine float")
    return [(r["q"], r["leaf"]) for r in top_n(found, ["q"], [F.col("cosine").desc(), F.col("leaf")], k).where("cosine > -9").collect()]


def probes_for(own: DataFrame, index: Index, k: int, recall: float) -> int:
    """How many lists have to be asked for this share of the true neighbours of ``TRIALS`` rows to lie in them: a power of
    two, and all lists if need be. The rows are those of the smallest hashes, compared with all rows."""
    rows = own.select("sample", "x").orderBy(F.xxhash64("sample", F.lit(1)), "sample").limit(TRIALS).toArrow()
    q = vectors(rows.column("x"))
    true = _exact(q, rows.column("sample").to_pylist(), own, k)
    total, probes = np.prod([float(len(c)) for c in index.levels]), 1
    while probes < total:
        i, j = index.nearby(q, probes)
        asked = set(zip(i.tolist(), j.tolist(), strict=True))
        if sum(t in asked for t in true) >= recall * len(true):
            break
        probes *= 2
    return probes


def nearest(points: DataFrame, k: int, probes: int | None = None, again: int = 8, recall: float = 0.97) -> DataFrame:
    """``sample, rank_no, other, cosine``: for every row of ``points(sample, vec)`` the ``k`` others of the highest
    cosine found, ties to the smaller sample.

    Each row asks the lists of its ``probes`` nearest centres, by default as many as hold the share ``recall`` of the true
    neighbours of some rows; of each list's codes the ``again * k`` best scores are computed exactly. Rows of zero vectors
    neither ask nor answer. With fewer others than ``k`` all found come out.
    """
    spark = points.sparkSession
    points = points.select("sample", "vec").where(F.exists("vec", lambda v: v != 0))
    index = build(points)
    if index is None:
        return spark.createDataFrame([], "sample string, rank_no int, other string, cosine double")
    own = written(members(points, index))
    asked = probes or probes_for(own, index, k, recall)
    sent = spark.sparkContext.broadcast(index)

    def block(left, right):
        parts = []
        if left.num_rows and right.num_rows:
            q, x = vectors(left.column("x"), np.float32), vectors(right.column("x"), np.float32)
            codes, base, mend = _bytes(right.column("code")), right.column("base").to_numpy(), right.column("parallel").to_numpy()
            xs, qs = np.array(right.column("sample").to_pylist(), object), np.array(left.column("sample").to_pylist(), object)
            top = min(again * k + 1, len(x))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                tables = sent.value.tables(part.astype(float))
                score = np.empty((len(part), len(x)), np.float32)
                for first, steps in tables.scan(codes, base):
                    score[:, first : first + len(steps)] = steps.T
                score += (mend / tables.step).astype(np.float32)[None]
                best = np.argpartition(-score, top - 1, axis=1)[:, :top] if top < len(x) else np.broadcast_to(np.arange(len(x)), score.shape)
                exact = np.einsum("id,ijd->ij", part, x[best])
                exact[xs[best] == qs[at : at + 256, None]] = -np.inf
                keep = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, top)]
                i = np.repeat(np.arange(len(part)), keep.shape[1])
                val = np.take_along_axis(exact, keep, 1).ravel()
                ok = np.isfinite(val)
                parts.append((qs[at + i[ok]], xs[np.take_along_axis(best, keep, 1).ravel()[ok]], val[ok]))
        a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, object)
        b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, object)
        c = np.concatenate([p[2] for p in parts]).astype(float) if parts else np.zeros(0)
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c)], names=["sample", "other", "cosine"])

    found = _scan(_asks(own, index, lambda index, q: index.nearby(q, asked)), own, block, "sample string, other string, cosine double")
    return top_n(found, ["sample"], [F.col("cosine").desc(), F.col("other")], k).select("sample", "rank_no", "other", "cosine")
