"""Ridge regression with a permutation null, as one Arrow kernel over blocks of samples.

A row of the input is a sample with its genes as ``idx`` and ``val``; a task fills a dense block of a few hundred
samples, so memory does not depend on the data's size, and everything a sample needs is in its block: no shuffle follows.
The projection and the permutations are of signature size and are broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import sane

EPS = 1e-12
#: Columns of one product of the kernel.
WIDTH = 256
RESULT = "feature string, sample string, beta double, se double, zscore double, pvalue double"


@dataclass
class Kernel:
    """What a block needs: T, the permutations, the row means to take off and how columns are normalised."""

    t: np.ndarray
    perms: np.ndarray
    row_means: np.ndarray | None = None
    centre: bool = True
    scale: bool = True
    places: np.ndarray | None = None  # the row of each gene number of the input; the same number if None

    def block(self, part: pa.RecordBatch) -> np.ndarray:
        """Genes by samples of some rows ``idx, val``."""
        return dense_block(part, self.t.shape[1], self.places)[0]

    def normalised(self, y: np.ndarray) -> np.ndarray:
        """The block with row means taken off and columns normalised."""
        if self.row_means is not None:
            y = y - self.row_means[:, None]
        if self.centre:
            y = y - y.mean(0)
        if self.scale and len(y) > 1:
            sd = y.std(0, ddof=1)
            y = y / np.where(sd < EPS, 1.0, sd)
        return y

    def __call__(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """beta, se, z and p of a block (genes by samples).

        The product with T comes first and the normalisation is applied to it: ``(T y - T r) / s - c m / s`` with
        ``c`` the row sums of T, which is the same for a permuted T.
        """
        t, n_rand = self.t, len(self.perms)
        if self.row_means is not None:
            y = y - self.row_means[:, None]
        mu = y.mean(0) if self.centre else np.zeros(y.shape[1])
        sigma = y.std(0, ddof=1) if self.scale and len(y) > 1 else np.ones(y.shape[1])
        # a column without spread is 0 after scaling (and 1 is its divisor where only scaling was asked for)
        sigma = np.where(sigma < EPS, 1.0, sigma)
        c = t.sum(1)

        def normal(q: np.ndarray) -> np.ndarray:
            return (q - c.reshape(-1, *[1] * (q.ndim - 1)) * mu) / sigma

        beta = normal(t @ y)
        size = np.abs(beta)
        total, square, beyond = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
        if y.shape[1] < t.shape[0]:  # move the rows of the block, for several permutations in one product
            wide = max(1, WIDTH // max(1, y.shape[1]))
            for at in range(0, n_rand, wide):
                moved = y[self.perms[at : at + wide].T]  # genes, permutations, samples
                q = normal((t @ moved.reshape(len(y), -1)).reshape(len(t), -1, y.shape[1]))
                total += q.sum(1)
                square += np.einsum("ijk,ijk->ik", q, q)
                beyond += (np.abs(q) >= size[:, None]).sum(1)
        else:  # or the columns of the projection, back
            for perm in self.perms:
                moved = np.empty_like(t)
                moved[:, perm] = t
                q = normal(moved @ y)
                total += q
                square += q * q
                beyond += np.abs(q) >= size
        if not n_rand:
            nan = np.full_like(beta, np.nan)
            return beta, nan, nan, nan
        mean = total / n_rand
        se = np.sqrt(np.maximum(square / n_rand - mean * mean, 0))
        z = np.divide(beta - mean, se, out=np.zeros_like(beta), where=se > EPS)
        return beta, se, z, (beyond + 1) / (n_rand + 1)


def dense_block(part: pa.RecordBatch, n_genes: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Genes by samples of some rows ``idx, val``, and which of them have a row. Of repeated rows of a gene and a sample the
    largest value counts, in whatever order they come."""
    idx, val = part.column("idx"), part.column("val").flatten().to_numpy(zero_copy_only=False)
    rows, column = idx.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(idx.offsets.to_numpy()))
    rows = rows if places is None else places[rows]
    y, seen = np.zeros((n_genes, part.num_rows)), np.zeros((n_genes, part.num_rows), bool)
    y[rows, column], seen[rows, column] = val, True
    again = np.flatnonzero(y[rows, column] != val)
    np.maximum.at(y, (rows[again], column[again]), val[again])
    return y, seen


def sample_rows(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """``sample, idx, val``: the values of each sample by the number of their genes in ``genes(gene, idx)``; samples
    without any of the genes have empty lists.

    ``genes`` has the size of a genome. A sample has a row a gene at most, so a group is bounded; where the rows are
    partitioned by sample already, as after ``scaled``, there is no shuffle.
    """
    rows = expr.join(F.broadcast(genes), "gene", "left").select("sample", F.when(F.col("idx").isNotNull(), F.struct("idx", sane().alias("v"))).alias("p"))
    got = rows.groupBy("sample").agg(F.collect_list("p").alias("p"))
    return got.select("sample", F.col("p.idx").alias("idx"), F.col("p.v").alias("val"))


def gene_sums(samples: DataFrame, n_genes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each gene number the rows it has and their sum, and the number of samples, in one pass over blocks."""

    def run(batches):
        rows, total, n = np.zeros(n_genes), np.zeros(n_genes), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                y, seen = dense_block(b.slice(at, 256), n_genes)
                rows += seen.sum(1)
                total += y.sum(1)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_genes, dtype=np.int32)), pa.array(np.append(n, rows)), pa.array(np.append(0.0, total))], ["idx", "n", "s"])

    got = samples.select("idx", "val").mapInArrow(run, "idx int, n double, s double").groupBy("idx").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    rows, total = np.zeros(n_genes + 1), np.zeros(n_genes + 1)
    rows[got["idx"] + 1], total[got["idx"] + 1] = got["n"], got["s"]
    return rows[1:], total[1:], int(rows[0])


def _long(features: list[str], samples: pa.Array, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Matrices of features by samples as rows ``feature, sample, ...``."""
    names = pa.array(np.tile(np.array(features, object), len(samples)), pa.string())
    columns = [names, samples.take(pa.array(np.repeat(np.arange(len(samples)), len(features))))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.T.ravel()) for x in values.values()]], ["feature", "sample", *values])


def run_kernel(samples: DataFrame, kernel: Kernel, features: list[str], batch_size: int = 512) -> DataFrame:
    """``feature, sample, beta, se, zscore, pvalue`` for ``samples(sample, idx, val)``."""
    sent = samples.sparkSession.sparkContext.broadcast((kernel, features))

    def run(batches):
        kernel, features = sent.value
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                yield _long(features, part.column("sample"), dict(zip(("beta", "se", "zscore", "pvalue"), kernel(kernel.block(part)), strict=True)))

    return samples.mapInArrow(run, RESULT)


def run_by_permutations(samples: DataFrame, kernel: Kernel, features: list[str], parts: int) -> DataFrame:
    """The same results for few samples and many permutations: every part runs a range of the permutations, and the
    sums of betas, of their squares and of the counts add up, since all three are algebraic."""
    spark = samples.sparkSession
    n_rand = len(kernel.perms)
    sent = spark.sparkContext.broadcast((kernel, features))
    spread = samples.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")

    def run(batches):
        kernel, features = sent.value
        cuts = np.linspace(0, n_rand, parts + 1).astype(int)
        for b in batches:
            part = b.column("part").to_numpy()
            for k in np.unique(part):
                mine = b.take(pa.array(np.flatnonzero(part == k)))
                own = Kernel(kernel.t, kernel.perms[cuts[k] : cuts[k + 1]], kernel.row_means, kernel.centre, kernel.scale)
                n = len(own.perms)
                for at in range(0, mine.num_rows, WIDTH):
                    some = mine.slice(at, WIDTH)
                    beta, se, z, p = own(kernel.block(some))
                    # the sums again from the statistics of this range
                    mean = beta - z * se if n else np.zeros_like(beta)
                    s1, s2 = mean * n, (se**2 + mean**2) * n
                    beyond = p * (n + 1) - 1 if n else np.zeros_like(beta)
                    yield _long(features, some.column("sample"), {"beta": beta, "s1": np.nan_to_num(s1), "s2": np.nan_to_num(s2), "beyond": np.nan_to_num(np.round(beyond))})

    sums = spread.mapInArrow(run, "feature string, sample string, beta double, s1 double, s2 double, beyond double")
    sums = sums.groupBy("feature", "sample").agg(F.max("beta").alias("beta"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("beyond").alias("beyond"))
    mean = F.col("s1") / n_rand
    se = F.sqrt(F.greatest(F.col("s2") / n_rand - mean * mean, F.lit(0.0)))
    return sums.select("feature", "sample", "beta", se.alias("se"), F.when(se > EPS, (F.col("beta") - mean) / se).otherwise(0.0).alias("zscore"), ((F.col("beyond") + 1) / (n_rand + 1)).alias("pvalue"))


def ttest(samples: DataFrame, x: np.ndarray, features: list[str], lam: float, kernel: Kernel) -> DataFrame:
    """Ridge with a t-test instead of permutations: df = max(genes - features, 1), s2 = RSS / df,
    se = sqrt(diag((X'X + lam I)^-1) s2), z = t = beta / se, two-sided p."""
    from ..functions.distributions import t_two_sided

    inv = np.diag(np.linalg.pinv(x.T @ x + lam * np.eye(x.shape[1])))
    df = max(x.shape[0] - x.shape[1], 1)
    sent = samples.sparkSession.sparkContext.broadcast((kernel, x, inv, features))

    def run(batches):
        kernel, x, inv, features = sent.value
        for b in batches:
            for at in range(0, b.num_rows, WIDTH):
                some = b.slice(at, WIDTH)
                y = kernel.normalised(kernel.block(some))
                beta = kernel.t @ y
                s2 = ((y - x @ beta) ** 2).sum(0) / df
                se = np.sqrt(np.maximum(inv[:, None] * s2, 0))
                t = np.divide(beta, se, out=np.zeros_like(beta), where=se > EPS)
                yield _long(features, some.column("sample"), {"beta": beta, "se": se, "zscore": t, "pvalue": t_two_sided(t, df)})

    return samples.mapInArrow(run, RESULT)


def estimate_memory(n_genes: int, n_features: int, n_samples: int, n_rand: int = 1000, batch: int | None = None) -> dict[str, float]:
    """Gigabytes of the projection, the permutations, a block and its results; ``working_gb`` is a block's sums beside
    them, ``per_batch_gb`` what a block needs in all."""
    width = batch or n_samples
    gb = 1024.0**3
    parts = {"projection_gb": 8.0 * n_features * n_genes, "permutations_gb": 4.0 * n_rand * n_genes, "block_gb": 8.0 * n_genes * width, "results_gb": 32.0 * n_features * width}
    out = {k: v / gb for k, v in parts.items()}
    working = 32.0 * n_features * width / gb
    return out | {"total_gb": sum(out.values()), "working_gb": working, "per_batch_gb": out["block_gb"] + out["results_gb"] + working}


def estimate_batch_size(n_genes: int, n_features: int, available_gb: float, n_rand: int = 1000) -> int:
    """The samples of a block that fit 70 % of the memory beside the projection and the permutations, 100 to 50,000."""
    room = 0.7 * available_gb * 1024.0**3 - 8.0 * n_features * n_genes - 4.0 * n_rand * n_genes
    return int(min(50000, max(100, math.floor(room / (8 * n_genes + 32 * n_features)))))
