"""Preparation of expression tables ``gene, sample, value`` (an absent row is 0; null and NaN values are 0 as well).

Sums over genes or samples are hash aggregates with partial sums in the map tasks. The grid of all pairs is only made
by ``densify``; every other operator counts the zeros instead of writing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["gene", "sample"]


def sane(column: str = "value") -> Column:
    """A number with null and NaN as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def standard_symbol(column: str) -> Column:
    """Upper case, without what follows the first dot."""
    return F.substring_index(F.upper(F.col(column)), ".", 1)


def is_ensembl(column: str) -> Column:
    return F.col(column).startswith("ENSG") | F.col(column).startswith("ENSMUSG")


def resolve_symbols(var: DataFrame, candidates=("gene_name", "feature_name", "gene_symbol", "symbol"), name: str = "gene") -> DataFrame:
    """``var`` with ``name`` taken from the first candidate column when over half of the names are Ensembl ids."""
    found = next((c for c in candidates if c in var.columns), None)
    if found is None:
        return var
    share = var.agg(F.avg(is_ensembl(name).cast("int"))).first()[0] or 0.0
    return var.withColumn(name, F.col(found)) if share > 0.5 else var


def keep_first(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row a key, the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_best(stats: DataFrame, key: str, stat: str, pos: str) -> DataFrame:
    """Of rows with one key the one of the highest statistic, ties to the first position."""
    return keep_first(stats, key, [F.col(stat).desc(), F.col(pos).asc()])


def deduplicate_genes(counts: DataFrame, var: DataFrame, by: str = "mean") -> DataFrame:
    """Counts under standard symbols, where of the rows of one symbol the one with the highest mean (or sum) stays.

    ``counts(pos, sample, value)`` and ``var(pos, gene_raw)``. Mean and sum rank alike, since all rows have the same
    samples; zeros need no rows. Genes without any count stay in ``var`` with 0.
    """
    total = counts.groupBy("pos").agg(F.sum(sane()).alias("_total"))
    named = var.select("pos", standard_symbol("gene_raw").alias("gene")).join(total, "pos", "left").withColumn("_total", F.coalesce("_total", F.lit(0.0)))
    kept = keep_best(named, "gene", "_total", "pos").select("pos", "gene")
    return counts.join(kept, "pos").select("gene", "sample", "value")


def symbol_counts(counts: DataFrame) -> DataFrame:
    """``gene, sample, value[, pos]`` under standard symbols; of the genes of one symbol the one with the highest total stays,
    ties to the first ``pos``, or, without one, to the smaller name.

    Genes are told apart by their name and, where there is one, their ``pos``. The choice is one row a gene, a genome at most.
    """
    own = ["gene", *(["pos"] if "pos" in counts.columns else [])]
    total = counts.where("gene is not null").groupBy(*own).agg(F.sum(sane()).alias("_total")).withColumn("_symbol", standard_symbol("gene"))
    kept = keep_first(total, "_symbol", [F.col("_total").desc(), *[F.col(c) for c in reversed(own)]]).select(*own, "_symbol")
    return counts.join(kept, own).select(F.col("_symbol").alias("gene"), "sample", "value", *own[1:])


def drop_zero_genes(expr: DataFrame) -> DataFrame:
    kept = expr.groupBy("gene").agg(F.sum(sane()).alias("_s")).where("_s > 0").select("gene")
    return expr.join(kept, "gene", "left_semi")


def min_genes(expr: DataFrame, least: int) -> DataFrame:
    """Samples with at least ``least`` genes above 0."""
    kept = expr.groupBy("sample").agg(F.count_if(F.col("value") > 0).alias("_n")).where(F.col("_n") >= least).select("sample")
    return expr.join(kept, "sample", "left_semi")


def already_normalised(expr: DataFrame) -> DataFrame:
    """One row: ``max_value``, ``all_whole`` and ``normalised`` (small and not whole numbers), over all values."""
    agg = expr.agg(F.max("value").alias("max_value"), F.coalesce(F.bool_and(F.col("value") == F.round("value")), F.lit(True)).alias("all_whole"))
    return agg.withColumn("normalised", F.coalesce((F.col("max_value") < 20) & ~F.col("all_whole"), F.lit(False)))


def densify(expr: DataFrame) -> DataFrame:
    """A row for every gene of every sample. Genes are numbered once and generated for each sample."""
    genes = expr.select("gene").distinct()
    every = genes.agg(F.sort_array(F.collect_list("gene")).alias("_genes"))
    samples = expr.select("sample").distinct()
    grid = samples.join(F.broadcast(every)).select("sample", F.explode("_genes").alias("gene"))
    return grid.join(expr.select(*KEYS, sane().alias("_v")), KEYS, "left").select(*KEYS, F.coalesce("_v", F.lit(0.0)).alias("value"))


def scaled(expr: DataFrame, scale: float = 1e6) -> DataFrame:
    """Counts per ``scale``; a sample without counts stays 0."""
    total = F.sum(sane()).over(Window.partitionBy("sample"))
    return expr.select(*KEYS, F.when(total != 0, sane() / total * scale).otherwise(0.0).alias("value"))


def log2p1(expr: DataFrame) -> DataFrame:
    """``log2(value + 1)``; zeros stay zeros, so no rows are added."""
    return expr.select(*KEYS, F.log2(sane() + 1).alias("value"))


def gene_means(expr: DataFrame, n_samples: int | Column) -> DataFrame:
    """``gene, row_mean`` over all samples, zeros included."""
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    return expr.groupBy("gene").agg((F.sum(sane()) / n).alias("row_mean"))


def centred_grid(expr: DataFrame) -> DataFrame:
    """A row for every gene of every sample, minus the gene's mean over all samples: ``centre_rows`` of ``densify``.

    The means come from the rows that exist and travel with the genes, so the grid is made once and joined once.
    """
    n = expr.agg(F.count_distinct("sample").alias("_n"))
    every = expr.groupBy("gene").agg(F.sum(sane()).alias("s")).agg(F.collect_list(F.struct("gene", "s")).alias("_genes"))
    grid = expr.select("sample").distinct().join(F.broadcast(every.join(n))).select("sample", "_n", F.explode("_genes").alias("g"))
    values = expr.select(*KEYS, sane().alias("_v"))
    mean = F.when(F.col("_n") > 1, F.col("_s") / F.col("_n")).otherwise(0.0)
    return grid.select("sample", "_n", "g.gene", F.col("g.s").alias("_s")).join(values, KEYS, "left").select(*KEYS, (F.coalesce("_v", F.lit(0.0)) - mean).alias("value"))


def centre_rows(dense: DataFrame) -> DataFrame:
    """Every gene minus its mean over samples (of a dense table). A single sample is left as it is.

    The means, one a gene, come back by a join, so the table itself is not shuffled by gene.
    """
    mean = dense.groupBy("gene").agg(F.avg(sane()).alias("_m"), F.count("*").alias("_n"))
    return dense.join(mean, "gene").select(*KEYS, F.when(F.col("_n") > 1, sane() - F.col("_m")).otherwise(sane()).alias("value"))


def zscore_columns(dense: DataFrame, method: str = "zscore", eps: float = 0.0) -> DataFrame:
    """Every sample standardised over genes with the sample deviation (divided by it plus ``eps``), or centred only.

    A column without spread becomes 0.
    """
    if method == "none":
        return dense.select(*KEYS, sane().alias("value"))
    w = Window.partitionBy("sample")
    centred = sane() - F.avg(sane()).over(w)
    if method == "center":
        return dense.select(*KEYS, centred.alias("value"))
    if method != "zscore":
        raise ValueError("method is zscore, center or none")
    sd = F.stddev_samp(sane()).over(w)
    return dense.select(*KEYS, F.when(sd + eps > 0, centred / (sd + eps)).otherwise(0.0).alias("value"))


def against_control(treated: DataFrame, control: DataFrame) -> DataFrame:
    """Treated minus the control's mean over its samples, for the genes both have (dense tables)."""
    mean = control.groupBy("gene").agg(F.avg(sane()).alias("_m"))
    return treated.join(mean, "gene").select(*KEYS, (sane() - F.col("_m")).alias("value"))


def paired(treated: DataFrame, control: DataFrame) -> DataFrame:
    """Treated minus control for the genes and samples both have."""
    c = control.select(*KEYS, sane().alias("_c"))
    return treated.join(c, KEYS).select(*KEYS, (sane() - F.col("_c")).alias("value"))


def collapse(expr: DataFrame, name: str = "Change") -> DataFrame:
    """One sample: the mean over samples."""
    return expr.groupBy("gene").agg(F.avg(sane()).alias("value")).select("gene", F.lit(name).alias("sample"), "value")


def differential(treated: DataFrame, control: DataFrame | None = None, is_paired: bool = False, aggregate: bool = True) -> DataFrame:
    """Difference to a control, to the paired sample, or to the mean of all samples; collapsed to one column if asked.

    Without a control the collapsed difference is 0 for every gene.
    """
    if control is None:
        if is_paired:
            raise ValueError("a paired difference needs a control")
        diff = centre_rows(treated)
    else:
        diff = paired(treated, control) if is_paired else against_control(treated, control)
    return collapse(diff, "differential") if aggregate else diff


def control_slide(spots: DataFrame, control_rows: DataFrame) -> DataFrame:
    """Spots minus the control slide's mean per gene; of control genes that occur twice the last one counts.

    ``control_rows(pos, gene, value_mean)``.
    """
    last = keep_first(control_rows, "gene", [F.col("pos").desc()])
    return spots.join(last.select("gene", F.col("value_mean").alias("_m")), "gene").select(*KEYS, (sane() - F.col("_m")).alias("value"))


def pseudobulk_sum(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts summed by cell type (``sample`` becomes the type); samples without a type drop out."""
    typed = expr.join(obs.where("cell_type is not null").select("sample", "cell_type"), "sample")
    return typed.groupBy("gene", F.col("cell_type").alias("sample")).agg(F.sum(sane()).alias("value"))


def pseudobulk_mean(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean by cell type over all its samples, zeros included."""
    obs = obs.where("cell_type is not null").select("sample", "cell_type")
    size = obs.groupBy("cell_type").agg(F.count("*").alias("_n"))
    total = expr.join(obs, "sample").groupBy("gene", "cell_type").agg(F.sum(sane()).alias("_s"))
    return total.join(size, "cell_type").select("gene", F.col("cell_type").alias("sample"), (F.col("_s") / F.col("_n")).alias("value"))


def column_stats(expr: DataFrame, n_genes: int | None = None, eps: float = 1e-12) -> DataFrame:
    """``sample, mu, sigma`` over all genes (those that have rows unless their number is given) from the rows that exist;
    sigma below ``eps`` is 1."""
    total = expr.agg((F.lit(n_genes) if n_genes else F.count_distinct("gene")).cast("double").alias("_g"))
    g = F.col("_g")
    agg = expr.groupBy("sample").agg(F.sum(sane()).alias("s1"), F.sum(sane() * sane()).alias("s2")).join(F.broadcast(total))
    mu = F.col("s1") / g
    sigma = F.sqrt(F.greatest((F.col("s2") - g * mu * mu) / (g - 1), F.lit(0.0)))
    return agg.select("sample", mu.alias("mu"), F.when(sigma < eps, 1.0).otherwise(sigma).alias("sigma"))


def population_stats(expr: DataFrame, n_genes: int | None = None, n_samples: int | None = None, eps: float = 1e-12) -> DataFrame:
    """``sample, mu, sigma`` of row-centred columns, without centring any row; the numbers of genes and samples are those
    that have rows unless given.

    With row means r: mu' = mu - mean(r), var' = (sum y^2 - 2 sum y r + sum r^2 - n mu'^2) / (n - 1).
    """
    sums = expr.groupBy("gene").agg(F.sum(sane()).alias("_s"))
    totals = sums.agg((F.lit(n_genes) if n_genes else F.count("*")).cast("double").alias("_g"), F.sum("_s").alias("_t"), F.sum(F.col("_s") * F.col("_s")).alias("_t2"))
    n = expr.agg((F.lit(n_samples) if n_samples else F.count_distinct("sample")).cast("double").alias("_n"))
    agg = expr.join(sums, "gene").groupBy("sample").agg(F.sum(sane()).alias("s1"), F.sum(sane() * sane()).alias("s2"), F.sum(sane() * F.col("_s")).alias("st"))
    both = agg.join(F.broadcast(totals.join(n)))
    g, n = F.col("_g"), F.col("_n")
    mu = F.col("s1") / g - F.col("_t") / n / g
    var = F.greatest((F.col("s2") - 2 * F.col("st") / n + F.col("_t2") / n / n - g * mu * mu) / (g - 1), F.lit(0.0))
    sigma = F.sqrt(var)
    return both.select("sample", mu.alias("mu"), F.when(sigma < eps, 1.0).otherwise(sigma).alias("sigma"))


def measured_features(sig: DataFrame, expr: DataFrame) -> DataFrame:
    """Signature columns whose feature is a measured gene."""
    return sig.join(expr.select(F.col("gene").alias("feature")).distinct(), "feature", "left_semi")


def common_genes(sig: DataFrame, expr: DataFrame) -> DataFrame:
    """The genes both have."""
    return sig.select("gene").distinct().join(expr.select("gene").distinct(), "gene", "left_semi")


def drop_non_numeric(wide: DataFrame, keep: list[str]) -> DataFrame:
    """Columns as doubles; those without any number are dropped."""
    rest = [c for c in wide.columns if c not in keep]
    cast = wide.select(*keep, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in rest])
    if not rest:
        return cast
    has = cast.agg(*[F.count(f"`{c}`").alias(c) for c in rest]).first().asDict()
    return cast.select(*keep, *[c for c in rest if has[c]])


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that a column matches, whatever its case."""
    own = {c.lower(): c for c in reversed(columns)}
    return next((own[c.lower()] for c in candidates if c.lower() in own), None)


def name_single(expr: DataFrame, name: str = "Change") -> DataFrame:
    """The only sample renamed; tables of several samples stay as they are."""
    w = expr.agg(F.countDistinct("sample").alias("_n"))
    return expr.join(F.broadcast(w)).withColumn("sample", F.when(F.col("_n") == 1, F.lit(name)).otherwise(F.col("sample"))).drop("_n")
