"""The inference pipelines: bulk, single cell and spatial. Each declares one plan and returns
``feature, sample, beta, se, zscore, pvalue``."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linalg, prep, ridge, rng

LAMBDA = 5e5
N_RAND = 1000
#: Floating-point operations aimed at in one task of the kernel, some seconds' work.
TASK_FLOPS = 2e11


def _ordered(genes: list[str], sig: DataFrame, expr: DataFrame, order: str) -> list[str]:
    """Genes sorted by bytes, or by the ``pos`` of the signature or of the expression.

    A permutation addresses a gene by its place, so the order decides se, z and p (not beta).
    """
    if order not in ("sorted", "signature", "expression"):
        raise ValueError("order is sorted, signature or expression")
    source = {"signature": sig, "expression": expr}.get(order)
    if source is None or "pos" not in source.columns:
        return sorted(genes)
    place = {r["gene"]: r["pos"] for r in source.groupBy("gene").agg(F.min("pos").alias("pos")).collect()}
    return sorted(genes, key=lambda g: (place[g], g))


def common_genes(expr: DataFrame, sig: DataFrame, order: str = "sorted") -> list[str]:
    """The genes that the expression and the signature have, in the order a permutation sees them."""
    return _ordered([r["gene"] for r in prep.common_genes(sig, expr).collect()], sig, expr, order)


#: The one kernel; other names of the published interface stand for it or are refused.
BACKENDS = ("auto", "numpy")


def activity(
    expr: DataFrame, sig: DataFrame, *, lam: float = LAMBDA, n_rand: int = N_RAND, seed: int = 0, rng_method: str | None = None,
    use_gsl_rng: bool = True, centre_rows: bool = False, centre: bool = True, scale: bool = True, scale_signature: bool = True,
    grouping: bool = False, threshold: float = 0.9, sig_filter: bool = False, order: str = "sorted", order_by: DataFrame | None = None,
    batch_size: int = 512, min_genes: int = 2, permutation_parts: int | None = None, backend: str = "auto",
) -> DataFrame:
    """Activities of every sample of ``expr(gene, sample, value)``.

    ``centre_rows`` takes every gene's mean over the samples off (absent rows count as 0) without writing the zeros;
    ``centre`` and ``scale`` normalise each sample over the common genes; ``scale_signature`` does so for the features.
    ``grouping`` fits correlated features once, as their mean over all genes of the signature, and reports each. ``n_rand``
    0 gives the t-test. ``order_by(gene, pos)`` has the places of genes for the order ``expression`` if ``expr`` has none.
    ``permutation_parts`` spreads the permutations of few samples over so many tasks. The rows by sample stay cached
    until the session's cache is cleared.
    """
    if n_rand < 0 or batch_size < 1:
        raise ValueError("n_rand must not be negative and batch_size must be positive")
    if backend not in BACKENDS:
        raise ValueError(f"backend is {' or '.join(BACKENDS)}")
    if sig_filter:
        sig = prep.measured_features(sig, expr)
    known = sorted(r["gene"] for r in sig.select("gene").where("gene is not null").distinct().collect())
    samples, rows, sums, n = _samples(expr, known)
    number = {g: i for i, g in enumerate(known)}
    genes = _ordered([g for g in known if rows[number[g]]], sig, expr if order_by is None else order_by, order)
    if len(genes) < min_genes:
        samples.unpersist()
        raise ValueError(f"only {len(genes)} genes in common, {min_genes} are needed")
    if grouping:  # features are alike over the whole signature, before the genes meet
        x, features = linalg.group_features(*linalg.signature_matrix(sig, known), threshold)
        x = x[[number[g] for g in genes]]
    else:
        x, features = linalg.signature_matrix(sig, genes)
    if scale_signature:
        x = linalg.standardise(x)
    perms = rng.permutations(rng.chosen(rng_method, use_gsl_rng), len(genes), n_rand, seed) if n_rand else np.empty((0, len(genes)), np.int32)
    taken = np.array([number[g] for g in genes], int)
    kernel = ridge.Kernel(linalg.projection(x, lam), perms, sums[taken] / n if centre_rows and n > 1 else None, centre, scale, _places(taken, len(known)))
    samples = _spread(samples, n, kernel)
    if not n_rand:
        out = ridge.ttest(samples, x, features, lam, kernel)
    elif permutation_parts:
        out = ridge.run_by_permutations(samples, kernel, features, permutation_parts)
    else:
        out = ridge.run_kernel(samples, kernel, features, batch_size)
    return linalg.expand_features(out) if grouping else out


def _samples(expr: DataFrame, known: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """The rows by sample, computed once, with the rows and sums of each gene and the number of samples."""
    idx = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(known)], "gene string, idx int")
    samples = ridge.sample_rows(expr, idx).persist(StorageLevel.MEMORY_AND_DISK)
    return samples, *ridge.gene_sums(samples, len(known))


def _places(taken: np.ndarray, n_known: int) -> np.ndarray:
    """The row of each gene number; genes that are not taken are not in the data."""
    places = np.zeros(n_known, np.int64)
    places[taken] = np.arange(len(taken))
    return places


def _spread(samples: DataFrame, n: int, kernel: ridge.Kernel) -> DataFrame:
    """The kernel is bound by computing: rows that fill few partitions are spread by the products to come."""
    want = min(n, int(2.0 * n * kernel.t.size * max(len(kernel.perms), 1) / TASK_FLOPS) + 1)
    return samples.repartition(want) if want > samples.rdd.getNumPartitions() else samples


def with_projection(
    expr: DataFrame, t: np.ndarray, genes: list[str], features: list[str], *, n_rand: int = N_RAND, seed: int = 0, rng_method: str | None = "srand",
    centre: bool = False, scale: bool = False, batch_size: int = 512,
) -> DataFrame:
    """Activities by a given projection ``t`` (features by genes); genes without rows are 0, others are left out. Only with
    permutations, since the t-test needs the signature."""
    if n_rand < 1:
        raise NotImplementedError("a given projection allows permutations only")
    if t.shape != (len(features), len(genes)) or len(set(genes)) < len(genes):
        raise ValueError("the projection has a row a feature and a column a gene, each gene once")
    samples, _, _, n = _samples(expr, list(genes))
    kernel = ridge.Kernel(np.asarray(t, float), rng.permutations(rng.chosen(rng_method), len(genes), n_rand, seed), None, centre, scale)
    return ridge.run_kernel(_spread(samples, n, kernel), kernel, features, batch_size)


def prepare(expr: DataFrame, sig: DataFrame, *, scale: bool = True, min_genes: int = 10) -> tuple[DataFrame, list[str]]:
    """``gene, sample, value`` of the common genes, scaled over them within each sample if asked, and these genes in the
    signature's order. Zeros have rows."""
    genes = common_genes(expr, sig, "signature")
    if len(genes) < min_genes:
        raise ValueError(f"only {len(genes)} genes in common, {min_genes} are needed")
    known = expr.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    rows = prep.densify(expr.join(known, "gene", "left_semi"))
    return (prep.zscore_columns(rows) if scale else rows), genes


def described(expr: DataFrame, sig: DataFrame, *, min_genes: int = 10, **options) -> tuple[DataFrame, dict]:
    """``activity`` with the order of the signature, and what it was computed with."""
    genes = common_genes(expr, sig, "signature")
    given = {"lam": LAMBDA, "n_rand": N_RAND, "seed": 0, "rng_method": "srand"} | options
    out = activity(expr, sig, order="signature", min_genes=min_genes, **given)
    n = sig.agg(F.countDistinct("feature")).first()[0]
    return out, given | {"n_genes": len(genes), "n_features": n, "method": "permutation" if given["n_rand"] else "ttest"}


#: What the pipelines do unless told otherwise: correlated features are fitted as one, and genes keep the order of the
#: expression, where its table has one.
_USUAL = {"grouping": True, "order": "expression"}


def bulk(treated: DataFrame, sig: DataFrame, control: DataFrame | None = None, *, is_differential: bool = False, is_paired: bool = False, single_sample: bool = False, **options) -> DataFrame:
    """Bulk profiles: the difference to a control (paired, or to its mean), or to the mean of all samples, then
    ``activity``. With a control the samples collapse to one column, ``Change``, unless ``single_sample``."""
    options = _USUAL | {"order_by": treated} | options
    if is_differential:
        return activity(prep.name_single(treated), sig, **options)
    if control is None:
        return activity(prep.name_single(treated), sig, centre_rows=True, **options)
    diff = prep.paired(treated, control) if is_paired else prep.against_control(treated, control)
    return activity(diff if single_sample else prep.collapse(diff), sig, **options)


def single_cell(counts: DataFrame, sig: DataFrame, obs: DataFrame | None = None, *, per_cell: bool = False, normalised: bool | None = None, symbols: bool = True, **options) -> DataFrame:
    """Counts of cells, by cell type (summed, per million) or by cell (per 100,000), as log2 against the mean.

    ``symbols``: genes go by their standard symbols, of which the gene with the highest total stays. Values that are
    normalised already (``None``: found out from all of them) are averaged by cell type instead of summed and scaled.
    """
    if not per_cell and obs is None:
        raise ValueError("cell types are needed unless per_cell")
    if symbols:
        counts = prep.symbol_counts(counts)
    options = _USUAL | {"order_by": counts} | options
    if per_cell:
        expr = counts if normalised else prep.log2p1(prep.scaled(counts, 1e5))
        return activity(expr, sig, centre_rows=True, **options)
    if normalised is None:
        normalised = prep.already_normalised(counts).first()["normalised"]
    expr = prep.pseudobulk_mean(counts, obs) if normalised else prep.log2p1(prep.scaled(prep.pseudobulk_sum(counts, obs), 1e6))
    return activity(expr, sig, centre_rows=True, **options)


def spatial(counts: DataFrame, sig: DataFrame, obs: DataFrame | None = None, *, by_type: bool = False, scale_factor: float = 1e5, least_genes: int = 0, control: DataFrame | None = None, symbols: bool = True, **options) -> DataFrame:
    """Counts of spots as log2 of their share times ``scale_factor``, against the mean or a control slide's mean; genes go by
    their standard symbols as in ``single_cell``."""
    if by_type and obs is None:
        raise ValueError("cell types are needed for by_type")
    if least_genes:
        counts = prep.min_genes(counts, least_genes)
    counts = prep.drop_zero_genes(counts)
    if symbols:
        counts = prep.symbol_counts(counts)
        control = control if control is None else prep.symbol_counts(control)
    options = _USUAL | {"order_by": counts} | options
    expr = prep.log2p1(prep.scaled(counts, scale_factor))
    if by_type:
        expr = prep.pseudobulk_mean(expr, obs)
    if control is None:
        return activity(expr, sig, centre_rows=True, **options)
    slide = prep.log2p1(prep.scaled(control, scale_factor))
    n = control.select("sample").distinct().count()
    base = prep.gene_means(slide, max(n, 1)).withColumnRenamed("row_mean", "value_mean").withColumn("pos", F.lit(0))
    return activity(prep.control_slide(prep.densify(expr), base), sig, **options)


def communication(expr: DataFrame, obs: DataFrame, sig: DataFrame, case: str | None = None, control: str | None = None, *, z_cutoff: float = 2.0, logfc_cutoff: float = 0.2, fraction_cutoff: float = 0.1, least_cells: int = 3, **options) -> DataFrame:
    """``sender, receiver, secretedProtein, activity_z``: proteins whose activity changes in a cell type and whose gene
    changes and is expressed there, with every other type as a sender.

    ``obs(sample, cell_type[, condition])``; without conditions a type is compared with all others. Means by type and
    condition come from one aggregate; the receivers join the senders on inequality, both as many as cell types.
    """
    typed = obs.where("cell_type is not null")
    n_case, n_ctrl, sums = _case_control(expr, typed, case, control)
    both = n_case.join(n_ctrl, "cell_type").where((F.col("nc") >= least_cells) & (F.col("nk") >= least_cells))
    means = sums.join(F.broadcast(both), "cell_type").select(
        "cell_type", "gene", (F.col("sc") / F.col("nc")).alias("case"), (F.col("sk") / F.col("nk")).alias("control"), (F.col("pc") / F.col("nc")).alias("fraction")
    )
    change = means.select("gene", F.col("cell_type").alias("sample"), (F.col("case") - F.col("control")).alias("value"))
    z = activity(change, sig, **options).where(F.abs("zscore") > z_cutoff)
    logfc = F.log2(F.col("case") + 1) - F.log2(F.col("control") + 1)
    own = means.where((F.abs(logfc) > logfc_cutoff) & (F.col("fraction") > fraction_cutoff)).select(F.col("cell_type").alias("receiver"), F.col("gene").alias("secretedProtein"))
    hits = z.select(F.col("sample").alias("receiver"), F.col("feature").alias("secretedProtein"), F.col("zscore").alias("activity_z")).join(own, ["receiver", "secretedProtein"])
    return senders(both.select("cell_type"), hits).select("sender", "receiver", "secretedProtein", "activity_z")


def senders(types: DataFrame, receivers: DataFrame) -> DataFrame:
    """Every row of ``receivers(receiver, ...)`` with every other one of ``types(cell_type)`` as its ``sender``; cell types are
    few, so this is one row a type for a receiver, on the side of which Spark finds the smaller."""
    own = types.select(F.col("cell_type").alias("sender"))
    return receivers.join(own, F.col("sender") != F.col("receiver"))


def shared_types(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cell types that both tables ``(..., cell_type)`` have."""
    return a.select("cell_type").intersect(b.select("cell_type"))


def _case_control(expr: DataFrame, typed: DataFrame, case: str | None, control: str | None):
    v = prep.sane()
    if case is not None:
        typed = typed.where(F.col("condition").isin(case, control))
        side = F.col("condition") == case
        size = typed.groupBy("cell_type").agg(F.count_if(side).alias("nc"), F.count_if(~side).alias("nk"))
        sums = expr.join(typed, "sample").groupBy("cell_type", "gene").agg(
            F.sum(F.when(side, v).otherwise(0.0)).alias("sc"), F.sum(F.when(~side, v).otherwise(0.0)).alias("sk"), F.count_if(side & (v > 0)).alias("pc")
        )
        return size.select("cell_type", "nc"), size.select("cell_type", "nk"), sums
    size = typed.groupBy("cell_type").agg(F.count("*").alias("nc"))
    total = size.agg(F.sum("nc").alias("t"))
    own = expr.join(typed, "sample").groupBy("cell_type", "gene").agg(F.sum(v).alias("sc"), F.count_if(v > 0).alias("pc"))
    gene = own.groupBy("gene").agg(F.sum("sc").alias("g"))
    # a gene that one type lacks has a sum of 0 there
    grid = size.select("cell_type").join(F.broadcast(gene.agg(F.collect_list(F.struct("gene", "g")).alias("gs")))).select("cell_type", F.explode("gs").alias("x")).select("cell_type", "x.gene", "x.g")
    sums = grid.join(own, ["cell_type", "gene"], "left").select("cell_type", "gene", F.coalesce("sc", F.lit(0.0)).alias("sc"), (F.col("g") - F.coalesce("sc", F.lit(0.0))).alias("sk"), F.coalesce("pc", F.lit(0)).alias("pc"))
    others = size.join(F.broadcast(total)).select("cell_type", (F.col("t") - F.col("nc")).alias("nk"))
    return size, others, sums


def spatial_communication(*_args, **_options) -> DataFrame:
    """Communication between neighbouring spots is left to a package of its own, which is not part of this engine."""
    raise ImportError("spatial communication needs an external package")
