"""Every query of the engine's own operators by name, with SQL that says the same.

Numbers that two engines may sum in another order are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, linalg, prep, ridge, rng, spatial, stats
from . import adapter, fits_sql, frames, pipelines
from .adapter import sql
from .tables_sql import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RADIUS, SIGMA = 20.0, 10.0


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded, with -0 as 0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def dense(spark, d):
    return prep.densify(adapter.expression(spark, d))


def logged(spark, d):
    return prep.log2p1(prep.scaled(dense(spark, d), 1e6))


def logged_rows(spark, d):
    """The same without rows for zeros, which the kernel needs not."""
    return prep.log2p1(prep.scaled(adapter.expression(spark, d), 1e6))


# --- preparation ----------------------------------------------------------------------------------------------------


@query(sql("expr", "dense") + "SELECT gene, sample, value FROM dense")
def densify_counts(spark, d):
    return dense(spark, d)


@query(sql("expr", "dense", "cpm") + "SELECT gene, sample, round(value, 6) + 0.0 AS value FROM cpm")
def cpm_log2(spark, d):
    return rounded(logged(spark, d), "value")


@query(sql("expr", "dense", "cpm", "diff") + "SELECT gene, sample, round(value, 6) + 0.0 AS value FROM diff")
def row_center(spark, d):
    return rounded(prep.centred_grid(logged_rows(spark, d)), "value")


_Z = """, z AS (SELECT gene, sample, (value - avg(value) OVER (PARTITION BY sample)) / stddev_samp(value) OVER (PARTITION BY sample) AS value FROM diff)"""


@query(sql("expr", "dense", "cpm", "diff") + _Z + " SELECT gene, sample, round(value, 6) + 0.0 AS value FROM z")
def zscore_cols(spark, d):
    return rounded(prep.zscore_columns(prep.centred_grid(logged_rows(spark, d))), "value")


@query(sql("expr", "dense", "cpm", "diff") + "SELECT gene, sample, round((value - avg(value) OVER (PARTITION BY sample)) / (stddev_samp(value) OVER (PARTITION BY sample) + 1e-12), 6) + 0.0 AS value FROM diff")
def scale_columns_eps(spark, d):
    return rounded(prep.zscore_columns(prep.centred_grid(logged_rows(spark, d)), eps=1e-12), "value")


@query(sql("expr", "dense", "cpm") + "SELECT gene, sample, round(value - avg(value) OVER (PARTITION BY sample), 6) + 0.0 AS value FROM cpm")
def center_cols(spark, d):
    return rounded(prep.zscore_columns(logged(spark, d), "center"), "value")


@query(sql("symbols") + "SELECT pos, split_part(upper(gene_raw), '.', 1) AS gene FROM symbols")
def symbol_standardize(spark, d):
    return adapter.raw_symbols(spark, d).select("pos", prep.standard_symbol("gene_raw").alias("gene"))


@query(sql("symbols") + "SELECT pos, gene_raw FROM (SELECT *, row_number() OVER (PARTITION BY split_part(upper(gene_raw), '.', 1) ORDER BY pos) AS k FROM symbols) WHERE k = 1")
def gene_dedupe_first(spark, d):
    rows = adapter.raw_symbols(spark, d).withColumn("gene", prep.standard_symbol("gene_raw"))
    return prep.keep_first(rows, "gene", ["pos"]).select("pos", "gene_raw")


def _part_counts(spark, d):
    lines = adapter.table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_partkey").cast("int").alias("pos"), adapter.sample_name("l_suppkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))


@query(
    sql("symbols")
    + """, n AS (SELECT s.pos, split_part(upper(gene_raw), '.', 1) AS gene, coalesce(t.total, 0) AS total FROM symbols s
  LEFT JOIN (SELECT l_partkey AS pos, sum(l_quantity) AS total FROM lineitem GROUP BY 1) t ON t.pos = s.pos),
best AS (SELECT pos, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY total DESC, pos) AS k FROM n) WHERE k = 1)
SELECT gene, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample, sum(l_quantity) AS value FROM lineitem JOIN best ON pos = l_partkey GROUP BY 1, 2"""
)
def gene_dedupe_best(spark, d):
    return prep.deduplicate_genes(_part_counts(spark, d), adapter.raw_symbols(spark, d))


@query(sql("sexpr") + "SELECT gene, sample, value FROM sexpr WHERE sample IN (SELECT sample FROM sexpr GROUP BY sample HAVING count(*) FILTER (value > 0) >= 500)")
def min_genes_filter(spark, d):
    return prep.min_genes(adapter.sparse_expression(spark, d), 500)


@query(sql("sexpr") + "SELECT gene, sample, value FROM (SELECT gene, sample, value - 25 AS value FROM sexpr) WHERE gene IN (SELECT gene FROM sexpr GROUP BY gene HAVING sum(value - 25) > 0)")
def zero_gene_filter(spark, d):
    return prep.drop_zero_genes(adapter.sparse_expression(spark, d).withColumn("value", F.col("value") - 25))


@query(sql("expr", "dense") + "SELECT max(value) AS max_value, bool_and(value = round(value)) AS all_whole, max(value) < 20 AND NOT bool_and(value = round(value)) AS normalised FROM dense")
def normalized_check(spark, d):
    return prep.already_normalised(dense(spark, d))


# --- joins, differences, pseudo-bulk ----------------------------------------------------------------------------------


_COMMON = "(SELECT DISTINCT gene FROM sig WHERE gene IN (SELECT gene FROM expr))"
_PLACE = "CAST(substr(gene, 2) AS INTEGER) * 37 % 211"


def _placed(rows):
    """Rows with a place of their gene in its table, in an order of its own."""
    return rows.withColumn("pos", F.substring("gene", 2, 20).cast("int") * 37 % 211)


@query(sql("expr", "sig") + f"SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_idx FROM {_COMMON}")
def gene_join_sorted(spark, d):
    return _numbered(spark, pipelines.common_genes(adapter.expression(spark, d), adapter.signature(spark, d)))


@query(sql("expr", "sig") + f"SELECT gene, CAST(row_number() OVER (ORDER BY {_PLACE}, gene) - 1 AS INTEGER) AS gene_idx FROM {_COMMON}")
def gene_join_sigorder(spark, d):
    return _numbered(spark, pipelines.common_genes(adapter.expression(spark, d), _placed(adapter.signature(spark, d)), "signature"))


@query(sql("expr", "sig") + f"SELECT gene, CAST(row_number() OVER (ORDER BY {_PLACE}, gene) - 1 AS INTEGER) AS gene_idx FROM {_COMMON}")
def gene_join_exprorder(spark, d):
    return _numbered(spark, pipelines.common_genes(_placed(adapter.expression(spark, d)), adapter.signature(spark, d), "expression"))


def _numbered(spark, genes):
    return spark.createDataFrame(list(enumerate(genes)), "gene_idx int, gene string")


@query(sql("expr", "dense", "cpm", "diff") + "SELECT gene, sample, round(value, 6) + 0.0 AS value FROM diff")
def diff_rowmean(spark, d):
    return rounded(prep.differential(logged(spark, d), aggregate=False), "value")


@query(sql("treated", "control") + "SELECT t.gene, t.sample, round(t.value - m.m, 6) + 0.0 AS value FROM treated t JOIN (SELECT gene, avg(value) AS m FROM control GROUP BY gene) m ON m.gene = t.gene")
def diff_control_mean(spark, d):
    return rounded(prep.differential(adapter.expression(spark, d, "R"), adapter.expression(spark, d, "N"), aggregate=False), "value")


@query(sql("treated", "control") + "SELECT t.gene, t.sample, t.value - c.value AS value FROM treated t JOIN control c ON c.gene = t.gene AND c.sample = t.sample")
def diff_paired(spark, d):
    return prep.differential(adapter.expression(spark, d, "R"), adapter.expression(spark, d, "N"), is_paired=True, aggregate=False)


@query(sql("treated", "control") + "SELECT t.gene, 'differential' AS sample, round(avg(t.value - m.m), 6) + 0.0 AS value FROM treated t JOIN (SELECT gene, avg(value) AS m FROM control GROUP BY gene) m ON m.gene = t.gene GROUP BY t.gene")
def collapse_change(spark, d):
    return rounded(prep.differential(adapter.expression(spark, d, "R"), adapter.expression(spark, d, "N")), "value")


@query(sql("expr", "labels") + "SELECT gene, cell_type AS sample, sum(value) AS value FROM expr JOIN labels USING (sample) GROUP BY gene, cell_type")
def pseudobulk_sum(spark, d):
    return prep.pseudobulk_sum(adapter.expression(spark, d), adapter.labels(spark, d))


@query(sql("expr", "labels") + "SELECT gene, cell_type AS sample, round(sum(value) / any_value(n), 6) AS value FROM expr JOIN labels USING (sample) JOIN (SELECT cell_type, count(*) AS n FROM labels GROUP BY 1) USING (cell_type) GROUP BY gene, cell_type")
def pseudobulk_mean(spark, d):
    return rounded(prep.pseudobulk_mean(adapter.expression(spark, d), adapter.labels(spark, d)), "value")


def _self_named(spark, d):
    """A signature whose features are named as genes, some of them measured."""
    s = adapter.signature(spark, d, 8)
    return s.withColumn("feature", F.concat(F.lit("G"), F.lpad((F.substring("feature", 2, 2).cast("int") * 50).cast("string"), 3, "0")))


@query(
    sql("expr")
    + """SELECT 'G' || CASE WHEN vec_id < 1000 THEN lpad(CAST(vec_id AS VARCHAR), 3, '0') ELSE CAST(vec_id AS VARCHAR) END AS gene, 'G' || lpad(CAST((i - 1) * 50 AS VARCHAR), 3, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS weight
FROM embeddings, (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) t(i) WHERE 'G' || lpad(CAST((i - 1) * 50 AS VARCHAR), 3, '0') IN (SELECT gene FROM expr)"""
)
def sig_filter_semi(spark, d):
    return prep.measured_features(_self_named(spark, d), adapter.expression(spark, d)).select("gene", "feature", "weight")


@query(sql("treated", "control") + "SELECT t.gene, t.sample, round(t.value - c.m, 6) + 0.0 AS value FROM treated t JOIN (SELECT gene, max(value) AS m FROM control GROUP BY gene) c ON c.gene = t.gene")
def control_slide_diff(spark, d):
    rows = adapter.expression(spark, d, "N").select("gene", F.col("value").alias("value_mean"), F.col("value").alias("pos"))
    return rounded(prep.control_slide(adapter.expression(spark, d, "R"), rows), "value")


@query(sql("expr", "sig") + "SELECT DISTINCT gene FROM expr WHERE gene NOT IN (SELECT gene FROM sig WHERE weight > 0)")
def genes_without_signature(spark, d):
    return compare.missing(adapter.expression(spark, d), adapter.signature(spark, d).where("weight > 0"), "gene")


@query(sql("labels") + "SELECT cell_type FROM labels JOIN (SELECT DISTINCT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample FROM lineitem WHERE l_returnflag = 'R') USING (sample) INTERSECT SELECT cell_type FROM labels JOIN (SELECT DISTINCT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample FROM lineitem WHERE l_returnflag = 'N') USING (sample)")
def shared_cell_types(spark, d):
    labels = adapter.labels(spark, d)
    return pipelines.shared_types(*[labels.join(adapter.expression(spark, d, f).select("sample").distinct(), "sample", "left_semi") for f in "RN"])


# --- statistics of sparse columns -------------------------------------------------------------------------------------

_G = "(SELECT count(DISTINCT gene) FROM sexpr)"


@query(
    sql("sexpr")
    + f"""SELECT sample, round(s1 / g, 6) AS mu, round(sqrt(greatest((s2 - g * (s1 / g) * (s1 / g)) / (g - 1), 0)), 6) AS sigma
FROM (SELECT sample, sum(value) AS s1, sum(value * value) AS s2, CAST(any_value({_G}) AS DOUBLE) AS g FROM sexpr GROUP BY sample)"""
)
def col_stats_sparse(spark, d):
    e = adapter.sparse_expression(spark, d)
    return rounded(prep.column_stats(e), "mu", "sigma")


@query(
    sql("sexpr")
    + """, gene AS (SELECT DISTINCT gene FROM sexpr), samp AS (SELECT DISTINCT sample FROM sexpr),
full_grid AS (SELECT gene, sample, coalesce(e.value, 0) AS value FROM gene CROSS JOIN samp LEFT JOIN sexpr e USING (gene, sample)),
c AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS value FROM full_grid)
SELECT sample, round(avg(value), 6) + 0.0 AS mu, round(stddev_samp(value), 6) AS sigma FROM c GROUP BY sample"""
)
def pop_stats_rowcenter(spark, d):
    e = adapter.sparse_expression(spark, d)
    return rounded(prep.population_stats(e), "mu", "sigma")


# --- ridge --------------------------------------------------------------------------------------------------------------

LAM, PERMS = 5.0, 20

_RIDGE = """, g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS pos FROM (SELECT DISTINCT gene FROM sig WHERE gene IN (SELECT gene FROM expr))),
yc AS (SELECT g.pos, d.sample, {y} AS v FROM {src} d JOIN g ON g.gene = d.gene),
y AS (SELECT pos, sample, {norm} AS v FROM yc),
xs AS (SELECT g.pos, s.feature, (s.weight - avg(s.weight) OVER (PARTITION BY s.feature)) / stddev_samp(s.weight) OVER (PARTITION BY s.feature) AS w FROM sig s JOIN g ON g.gene = s.gene),
x AS (SELECT pos, max(w) FILTER (feature = 'F00') AS a, max(w) FILTER (feature = 'F01') AS b FROM xs GROUP BY pos),
m AS (SELECT sum(a * a) + 5.0 AS aa, sum(b * b) + 5.0 AS bb, sum(a * b) AS ab FROM x),
t AS (SELECT pos, 'F00' AS feature, (bb * a - ab * b) / (aa * bb - ab * ab) AS t FROM x, m
  UNION ALL SELECT pos, 'F01', (aa * b - ab * a) / (aa * bb - ab * ab) FROM x, m),
beta AS (SELECT feature, sample, sum(t * v) AS beta FROM t JOIN y USING (pos) GROUP BY feature, sample)
"""
_ZNORM = "(v - avg(v) OVER (PARTITION BY sample)) / stddev_samp(v) OVER (PARTITION BY sample)"
_DENSE_RIDGE = sql("expr", "dense", "cpm", "diff", "sig") + _RIDGE.format(y="d.value", src="diff", norm=_ZNORM)


_FOUR = "feature, sample, round(beta, 6) + 0.0 AS beta, round(se, 6) AS se, round((beta - m) / se, 6) + 0.0 AS zscore, round(pvalue, 6) AS pvalue FROM s"


def _null_sql(method: str = "srand", select: str = f"SELECT {_FOUR}") -> str:
    """The statistics over the permutations, which are a literal table (``perm_table_*`` check how it is made)."""
    table = rng.permutations(method, adapter.N_GENES, PERMS, 0)
    rows = ", ".join(f"({k}, {i}, {p})" for k, perm in enumerate(table.tolist()) for i, p in enumerate(perm))
    return f""", p(k, pos, src) AS (VALUES {rows}),
q AS (SELECT p.k, t.feature, y.sample, sum(t.t * y.v) AS q FROM p JOIN t ON t.pos = p.pos JOIN y ON y.pos = p.src GROUP BY 1, 2, 3),
s AS (SELECT feature, sample, any_value(beta) AS beta, avg(q) AS m, sqrt(greatest(avg(q * q) - avg(q) * avg(q), 0)) AS se,
  (count(*) FILTER (abs(q) >= abs(beta)) + 1) / ({PERMS} + 1) AS pvalue FROM q JOIN beta USING (feature, sample) GROUP BY feature, sample)
{select}"""


def _perm_sql(method: str) -> str:
    return _DENSE_RIDGE + _null_sql(method)


def _four(out):
    return rounded(out, "beta", "se", "zscore", "pvalue")


def _ridge(spark, d, **options):
    settings = {"lam": LAM, "n_rand": PERMS, "centre_rows": True} | options
    return rounded(pipelines.activity(logged_rows(spark, d), adapter.signature(spark, d), **settings), "beta", "se", "zscore", "pvalue")


@query(_DENSE_RIDGE + "SELECT feature, sample, round(beta, 6) + 0.0 AS beta FROM beta")
def ridge_beta_2f(spark, d):
    return _ridge(spark, d).select("feature", "sample", "beta")


@query(_perm_sql("srand"))
def ridge_perm_2f(spark, d):
    return _ridge(spark, d)


@query(_perm_sql("gsl"))
def ridge_perm_gsl_2f(spark, d):
    return _ridge(spark, d, rng_method="gsl")


@query(_perm_sql("numpy"))
def ridge_perm_numpy_2f(spark, d):
    return _ridge(spark, d, rng_method="numpy")


@query(_perm_sql("srand"))
def ridge_batched_2f(spark, d):
    return _ridge(spark, d, batch_size=7)


@query(_perm_sql("srand"))
def ridge_split_permutations_2f(spark, d):
    return _ridge(spark, d, permutation_parts=4)


def _perm_table(spark, method: str):
    table = rng.permutations(method, 25, 4, 0)
    return spark.createDataFrame([(k, i, p) for k, perm in enumerate(table.tolist()) for i, p in enumerate(perm)], "perm_id int, pos int, src int")


@query(TABLES["srand"])
def perm_table_srand(spark, d):
    return _perm_table(spark, "srand")


@query(TABLES["gsl"])
def perm_table_gsl(spark, d):
    return _perm_table(spark, "gsl")


@query(TABLES["numpy"])
def perm_table_numpy(spark, d):
    return _perm_table(spark, "numpy")


@query(
    """WITH RECURSIVE """ + TABLES["srand"].removeprefix("WITH RECURSIVE ").replace("SELECT CAST(t // 24 - 1", ", made AS (SELECT CAST(t // 24 - 1", 1).replace("t > 0 AND t % 24 = 0", "t > 0 AND t % 24 = 0)", 1)
    + " SELECT perm_id, src AS pos, pos AS src FROM made"
)
def perm_table_inverse(spark, d):
    table = rng.inverse(rng.permutations("srand", 25, 4, 0))
    return spark.createDataFrame([(k, i, p) for k, perm in enumerate(table.tolist()) for i, p in enumerate(perm)], "perm_id int, pos int, src int")


@query(
    _DENSE_RIDGE
    + """, fit AS (SELECT pos, sample, sum(w * beta) AS f FROM xs JOIN beta USING (feature) GROUP BY pos, sample),
rss AS (SELECT sample, sum((v - f) * (v - f)) / greatest(count(*) - 2, 1) AS s2 FROM y JOIN fit USING (pos, sample) GROUP BY sample),
inv AS (SELECT 'F00' AS feature, bb / (aa * bb - ab * ab) AS i FROM m UNION ALL SELECT 'F01', aa / (aa * bb - ab * ab) FROM m)
SELECT feature, sample, round(beta, 6) + 0.0 AS beta, round(sqrt(i * s2), 6) AS se, round(beta / sqrt(i * s2), 6) + 0.0 AS zscore FROM beta JOIN rss USING (sample) JOIN inv USING (feature)"""
)
def ridge_ttest_2f(spark, d):
    return _ridge(spark, d, n_rand=0).select("feature", "sample", "beta", "se", "zscore")


_T_P = """, coef(k, c) AS (SELECT 0, CAST(1.0 AS DOUBLE) UNION ALL SELECT k + 1, c * (2 * k + 1) / (2 * k + 2) FROM coef WHERE k < {most}),
tt AS (SELECT feature, sample, beta, sqrt(i * s2) AS se, beta / sqrt(i * s2) AS z FROM beta JOIN rss USING (sample) JOIN inv USING (feature)),
cdf AS (SELECT feature, sample, sum(c * pow({df} / ({df} + z * z), k)) * abs(any_value(z)) / sqrt({df} + any_value(z) * any_value(z)) AS a FROM tt, coef GROUP BY feature, sample)
SELECT feature, sample, round(beta, 6) + 0.0 AS beta, round(se, 6) AS se, round(z, 6) + 0.0 AS zscore, round(1 - a, 6) + 0.0 AS pvalue FROM tt JOIN cdf USING (feature, sample)"""
_TTEST = ORACLES["ridge_ttest_2f"].rpartition("\nSELECT feature, sample")[0].replace("WITH ", "WITH RECURSIVE ", 1)


# Student's distribution as a finite series, for the even number of degrees of freedom that 200 genes and 2 features leave
@query(_TTEST + _T_P.format(df=adapter.N_GENES - 2, most=(adapter.N_GENES - 2) // 2 - 1))
def ridge_ttest_pvalues(spark, d):
    return _ridge(spark, d, n_rand=0)


def _sparse_sql(norm: str, y: str = "d.value") -> str:
    return sql("expr", "dense", "sig") + _RIDGE.format(y=y, src="dense", norm=norm) + "SELECT feature, sample, round(beta, 6) + 0.0 AS beta FROM beta"


def _sparse_ridge(spark, d, **flags):
    options = {"lam": LAM, "n_rand": 2, "centre": False, "scale": False} | flags
    return rounded(pipelines.activity(adapter.expression(spark, d), adapter.signature(spark, d), **options), "beta").select("feature", "sample", "beta")


@query(_sparse_sql("v"))
def ridge_sparse_raw_2f(spark, d):
    return _sparse_ridge(spark, d)


@query(_sparse_sql("v - avg(v) OVER (PARTITION BY sample)"))
def ridge_sparse_center_2f(spark, d):
    return _sparse_ridge(spark, d, centre=True)


@query(_sparse_sql("v / stddev_samp(v) OVER (PARTITION BY sample)"))
def ridge_sparse_scale_2f(spark, d):
    return _sparse_ridge(spark, d, scale=True)


@query(_sparse_sql(_ZNORM))
def ridge_sparse_norm_2f(spark, d):
    return _sparse_ridge(spark, d, centre=True, scale=True)


@query(_sparse_sql(_ZNORM, "d.value - avg(d.value) OVER (PARTITION BY d.gene)"))
def ridge_sparse_rowcenter_2f(spark, d):
    return _sparse_ridge(spark, d, centre=True, scale=True, centre_rows=True)


@query()
def ridge_full_64f(spark, d):
    """All 64 features with the production number of permutations and the production lambda."""
    return pipelines.activity(logged_rows(spark, d), adapter.signature(spark, d, 64), centre_rows=True)


# --- signatures ---------------------------------------------------------------------------------------------------------


@query(sql("sig") + "SELECT a.feature AS feature_a, b.feature AS feature_b, round(corr(a.weight, b.weight), 6) AS r FROM sig a JOIN sig b ON a.gene = b.gene AND a.feature < b.feature GROUP BY 1, 2")
def sig_corr_pairs(spark, d):
    return rounded(linalg.correlation_pairs(adapter.signature(spark, d)), "r")


@query(sql("sig") + "SELECT gene, 'F00|F01' AS feature, round(avg(weight), 6) + 0.0 AS weight FROM sig GROUP BY gene")
def sig_group_mean(spark, d):
    groups = spark.createDataFrame([("F00", "F00|F01"), ("F01", "F00|F01")], "feature string, grp string")
    return rounded(linalg.mean_signatures(adapter.signature(spark, d), groups), "weight")


@query(sql("sig") + "SELECT gene, f AS feature, round(w, 6) + 0.0 AS weight FROM (SELECT gene, avg(weight) AS w FROM sig GROUP BY gene), (VALUES ('F00'), ('F01')) t(f)")
def expand_rows(spark, d):
    return linalg.expand_features(sig_group_mean(spark, d))


@query()
def group_signatures(spark, d):
    s = adapter.signature(spark, d, 64)
    genes = sorted(r["gene"] for r in s.select("gene").distinct().collect())
    _, names = linalg.group_features(*linalg.signature_matrix(s, genes), 0.5)
    return spark.createDataFrame([(n, n.count("|") + 1) for n in names], "feature string, members int")


@query(
    """WITH w AS (SELECT gene, feature, coalesce(CASE WHEN isnan(weight) THEN NULL ELSE weight END, 0) AS w, weight FROM sig),
f AS (SELECT feature, coalesce(stddev_samp(w), 0) AS sd, max(abs(w)) AS m FROM w GROUP BY feature),
g AS (SELECT gene, max(c) AS c FROM (SELECT gene, feature, count(*) AS c FROM w GROUP BY gene, feature) GROUP BY gene)
SELECT (SELECT count(*) FILTER (weight IS NULL OR isnan(weight)) FROM w) AS n_missing, (SELECT count(*) FROM f) AS n_features, (SELECT count(*) FILTER (sd < 1e-12) FROM f) AS n_flat,
(SELECT count(*) FILTER (m = 0) FROM f) AS n_zero_features, (SELECT count(*) FROM g) AS n_genes, (SELECT count(*) FILTER (c > 1) FROM g) AS n_repeated_genes,
(SELECT count(*) FILTER (m = 0) FROM (SELECT gene, max(abs(w)) AS m FROM w GROUP BY gene)) AS n_zero_genes"""
)
def validate_signature(spark, d):
    return linalg.validate_signature(adapter.table(spark, d, "sig"))


# --- pipelines ----------------------------------------------------------------------------------------------------------


@query(sql("treated", "control", "sig") + """, expr AS (SELECT t.gene, 'Change' AS sample, avg(t.value - m.m) AS value FROM treated t JOIN (SELECT gene, avg(value) AS m FROM control GROUP BY gene) m ON m.gene = t.gene GROUP BY t.gene)"""
       + _RIDGE.format(y="d.value", src="expr", norm=_ZNORM) + _null_sql())
def bulk_activity(spark, d):
    out = pipelines.bulk(adapter.expression(spark, d, "R"), adapter.signature(spark, d), adapter.expression(spark, d, "N"), lam=LAM, n_rand=PERMS)
    return _four(out)


_TYPES = """, pb AS (SELECT gene, cell_type AS sample, sum(value) AS value FROM expr JOIN labels USING (sample) GROUP BY gene, cell_type),
pg AS (SELECT g.gene, s.sample, coalesce(pb.value, 0) AS value FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN (SELECT DISTINCT sample FROM pb) s LEFT JOIN pb ON pb.gene = g.gene AND pb.sample = s.sample),
pl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e6 + 1) AS value FROM pg),
pd AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS value FROM pl)"""


@query(sql("expr", "labels", "sig") + _TYPES + _RIDGE.format(y="d.value", src="pd", norm=_ZNORM) + _null_sql())
def sc_activity_pseudobulk(spark, d):
    out = pipelines.single_cell(adapter.expression(spark, d), adapter.signature(spark, d), adapter.labels(spark, d), lam=LAM, n_rand=PERMS)
    return _four(out)


_CELLS = """, cl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e5 + 1) AS value FROM dense),
cd AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS value FROM cl)"""


@query(sql("expr", "dense", "sig") + _CELLS + _RIDGE.format(y="d.value", src="cd", norm=_ZNORM) + _null_sql())
def sc_activity_cell(spark, d):
    out = pipelines.single_cell(adapter.expression(spark, d), adapter.signature(spark, d), per_cell=True, lam=LAM, n_rand=PERMS)
    return _four(out)


@query(ORACLES["sc_activity_cell"])
def st_activity_spot(spark, d):
    out = pipelines.spatial(adapter.expression(spark, d), adapter.signature(spark, d), lam=LAM, n_rand=PERMS)
    return _four(out)


@query(
    sql("expr", "dense", "labels", "sig")
    + """, cl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e5 + 1) AS value FROM dense),
ct AS (SELECT gene, cell_type AS sample, avg(value) AS value FROM cl JOIN labels USING (sample) GROUP BY 1, 2),
cd AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS value FROM ct)"""
    + _RIDGE.format(y="d.value", src="cd", norm=_ZNORM)
    + _null_sql()
)
def st_activity_type(spark, d):
    out = pipelines.spatial(adapter.expression(spark, d), adapter.signature(spark, d), adapter.labels(spark, d), by_type=True, lam=LAM, n_rand=PERMS)
    return _four(out)


_SLIDE = """, tg AS (SELECT DISTINCT gene FROM treated), ts AS (SELECT DISTINCT sample FROM treated),
td AS (SELECT tg.gene, ts.sample, coalesce(e.value, 0.0) AS value FROM tg CROSS JOIN ts LEFT JOIN treated e ON e.gene = tg.gene AND e.sample = ts.sample),
tl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e5 + 1) AS value FROM td),
cl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e5 + 1) AS value FROM control),
cm AS (SELECT gene, sum(value) / (SELECT count(DISTINCT sample) FROM control) AS m FROM cl GROUP BY gene),
sd AS (SELECT gene, sample, value - m AS value FROM tl JOIN cm USING (gene)), expr AS (SELECT DISTINCT gene FROM sd)"""


@query(sql("treated", "control", "sig") + _SLIDE + _RIDGE.format(y="d.value", src="sd", norm=_ZNORM) + _null_sql())
def st_activity_control(spark, d):
    return _four(pipelines.spatial(adapter.expression(spark, d, "R"), adapter.signature(spark, d), control=adapter.expression(spark, d, "N"), lam=LAM, n_rand=PERMS))


# --- downstream ---------------------------------------------------------------------------------------------------------

_PAIRS = f""", pr AS (SELECT a.sample AS a, b.sample AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM spots a JOIN spots b ON a.sample <> b.sample
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}),
wt AS (SELECT a, b, exp(-d * d / {2 * SIGMA**2}) / sum(exp(-d * d / {2 * SIGMA**2})) OVER (PARTITION BY a) AS w FROM pr)"""


@query(sql("spots") + _PAIRS + " SELECT a, b, round(d, 6) AS d FROM pr")
def spatial_pairs_radius(spark, d):
    return rounded(spatial.radius_pairs(adapter.spots(spark, d), RADIUS), "d")


@query(sql("spots") + _PAIRS + " SELECT a, b, round(w, 6) AS w FROM wt")
def spatial_weights(spark, d):
    return rounded(spatial.weights(adapter.spots(spark, d), RADIUS, SIGMA), "w")


_NEAR = """, nl AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e5 + 1) AS v FROM expr),
ne AS (SELECT gene, a AS sample, sum(v * w) AS value FROM nl JOIN wt ON wt.b = nl.sample GROUP BY 1, 2)"""


@query(sql("expr", "spots") + _PAIRS + _NEAR + " SELECT gene, sample, round(value, 6) AS value FROM ne")
def neighbor_expr(spark, d):
    return rounded(spatial.neighbour_expression(adapter.expression(spark, d), spatial.weights(adapter.spots(spark, d), RADIUS, SIGMA)), "value")


@query()
def signaling_patterns(spark, d):
    w = spatial.weights(adapter.spots(spark, d), RADIUS, SIGMA)
    near = spatial.neighbour_expression(adapter.expression(spark, d), w).persist()
    act = adapter.expression(spark, d).select(F.col("gene").alias("feature"), "sample", "value")
    found = spatial.patterns(act, spatial.neighbour_correlation(act, near), [2, 3])
    return found[0] if found else spark.createDataFrame([], "feature string, pattern string, weight double")


@query(
    """WITH v AS (SELECT feature, sample, run_id, max(CASE WHEN isnan(zscore) THEN NULL ELSE zscore END) AS z, max(CASE WHEN isnan(beta) THEN NULL ELSE beta END) AS b FROM activity GROUP BY 1, 2, 3),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY z) + (count(*) OVER (PARTITION BY feature, z) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY feature ORDER BY b) + (count(*) OVER (PARTITION BY feature, b) - 1) / 2 AS rb FROM v WHERE z IS NOT NULL AND b IS NOT NULL)
SELECT feature, round(corr(ra, rb), 6) AS r, count(*) AS n FROM r GROUP BY feature"""
)
def spearman_activity(spark, d):
    a = adapter.table(spark, d, "activity")
    clean = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    rows = a.groupBy("feature", "sample", "run_id").agg(clean("zscore"), clean("beta"))
    return rounded(stats.spearman(rows, ["feature"], "zscore", "beta"), "r").select("feature", "r", "n")


def _donors(spark, d):
    return adapter.survival(spark, d)


_KM = """, s AS (SELECT sample, r.t AS time, r.e AS event FROM survival), md AS (SELECT median(time) AS m FROM s),
g AS (SELECT *, CASE WHEN time > m THEN 'high' ELSE 'low' END AS grp FROM s, md),
k AS (SELECT *, count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY time, sample) + 1 AS at_risk FROM g)
SELECT grp, sample, time, CAST(at_risk AS BIGINT) AS at_risk, round(coalesce(exp(sum(CASE WHEN event = 1 THEN CASE WHEN at_risk > 1 THEN ln((at_risk - 1) / at_risk) ELSE -1e9 END ELSE 0 END)
  OVER (PARTITION BY grp ORDER BY time, sample)), 0), 6) AS survival FROM k"""


@query(sql("survival") + _KM)
def km_curve(spark, d):
    split = stats.median_split(_donors(spark, d), "time", [])
    out = stats.kaplan_meier(split, "grp")
    return rounded(out.withColumn("at_risk", F.col("at_risk").cast("long")), "survival")


_DONORS = """o AS (SELECT DISTINCT sample, donor FROM obs WHERE donor IS NOT NULL),
dm AS (SELECT feature, donor AS sample, avg(z) AS value FROM (SELECT feature, sample, max(zscore) AS z FROM activity WHERE zscore IS NOT NULL AND NOT isnan(zscore) GROUP BY feature, sample, run_id)
  JOIN o USING (sample) GROUP BY feature, donor),
dj AS (SELECT feature, round(value, 9) AS value, r.t AS t FROM dm JOIN survival USING (sample)),
rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2 AS rb FROM dj)"""


def _donor_means(spark, d):
    """``feature, sample, value``: the mean z-score over a donor's cells; copies of one result count once."""
    a = adapter.table(spark, d, "activity").where("zscore is not null and not isnan(zscore)").groupBy("feature", "sample", "run_id").agg(F.max("zscore").alias("z"))
    o = adapter.table(spark, d, "obs").where("donor is not null").select("sample", "donor").distinct()
    return a.join(o, "sample").groupBy("feature", F.col("donor").alias("sample")).agg(F.round(F.avg("z"), 9).alias("value"))


@query(sql("survival") + f", {_DONORS} SELECT feature, round(corr(ra, rb), 6) + 0.0 AS r, count(*) AS n FROM rk GROUP BY feature")
def risk_spearman(spark, d):
    """Risk of each feature by the mean z-score over a donor's cells."""
    return rounded(stats.risk_by_rank(_donor_means(spark, d), _donors(spark, d)), "r").select("feature", "r", "n")


@query(fits_sql.cox(sql("survival") + f", {_DONORS}, cx AS (SELECT feature, r.t AS t, r.e AS e, round(value, 9) AS v FROM dm JOIN survival USING (sample))"))
def cox_ph(spark, d):
    """Hazards by the mean z-score of each feature over a donor's cells."""
    mean = _donor_means(spark, d).withColumnRenamed("value", "act")
    return rounded(stats.cox(mean.join(_donors(spark, d), "sample"), "feature", "time", "event", ["act"]), "risk_score_z", "p_value", digits=5)


@query(fits_sql.logit("SELECT CAST(1.0 AS DOUBLE) AS x0, ln(o_totalprice) AS x1, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders", ("one", "big"), False))
def logit_fit(spark, d):
    o = adapter.table(spark, d, "orders").withColumn("one", F.lit(1.0)).withColumn("big", F.ln("o_totalprice")).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(stats.logit(o, "y", ["one", "big"], firth=False), "beta", "se", "z", "p")


@query(fits_sql.logit("SELECT CAST(1.0 AS DOUBLE) AS x0, time / 365 AS x1, CAST(event AS DOUBLE) AS y FROM clinical WHERE time IS NOT NULL AND event IS NOT NULL", ("one", "years"), True))
def logit_firth(spark, d):
    o = adapter.table(spark, d, "clinical").where("time is not null and event is not null").withColumn("one", F.lit(1.0)).withColumn("years", F.col("time") / 365)
    return rounded(stats.logit(o, "event", ["one", "years"]), "beta", "se", "z", "p")


_FLAGS = "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END"


@query(f"""WITH w AS (SELECT 'G' || CAST(l_partkey AS VARCHAR) AS feature, {_FLAGS} AS pattern, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)
SELECT feature, pattern, weight FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY weight DESC, pattern) AS k FROM w) WHERE k = 1""")  # fmt: skip
def pattern_gene_argmax(spark, d):
    w = adapter.table(spark, d, "lineitem").groupBy(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("feature"), F.expr(_FLAGS).alias("pattern")).agg(F.sum("l_quantity").alias("weight"))
    first, second, third = (spatial.pattern_genes(w, p) for p in "123")
    return first.unionByName(second).unionByName(third)


_CHANGE = """, sz AS (SELECT cell_type, count(*) AS nc FROM labels GROUP BY 1), tot AS (SELECT sum(nc) AS t FROM sz),
own AS (SELECT gene, cell_type, sum(value) AS sc, count(*) FILTER (value > 0) AS pc FROM expr JOIN labels USING (sample) GROUP BY 1, 2),
gs AS (SELECT gene, sum(sc) AS g FROM own GROUP BY gene),
mn AS (SELECT sz.cell_type, gs.gene, coalesce(sc, 0) / nc AS ca, (g - coalesce(sc, 0)) / (t - nc) AS co, coalesce(pc, 0) / nc AS fr
  FROM sz CROSS JOIN gs CROSS JOIN tot LEFT JOIN own ON own.gene = gs.gene AND own.cell_type = sz.cell_type WHERE nc >= 3 AND t - nc >= 3),
chg AS (SELECT gene, cell_type AS sample, ca - co AS value FROM mn)"""
_HITS = """, z AS (SELECT sample AS receiver, CASE feature WHEN 'F00' THEN 'G000' ELSE 'G050' END AS gene, (beta - m) / se AS z FROM s)
SELECT sz.cell_type AS sender, receiver, gene AS secretedProtein, round(z, 6) + 0.0 AS activity_z FROM z JOIN mn ON mn.cell_type = receiver AND mn.gene = z.gene
JOIN sz ON sz.cell_type <> receiver WHERE abs(z) > 0.1 AND abs(log2(ca + 1) - log2(co + 1)) > 0.001 AND fr > 0.1 AND sz.nc >= 3 AND (SELECT t FROM tot) - sz.nc >= 3"""


@query(sql("expr", "labels", "sig") + _CHANGE + _RIDGE.format(y="d.value", src="chg", norm=_ZNORM) + _null_sql(select="").rstrip() + _HITS.replace("gene AS secretedProtein", "z.gene AS secretedProtein"))
def ccc_pairs_2f(spark, d):
    sig = adapter.signature(spark, d).withColumn("feature", F.when(F.col("feature") == "F00", "G000").otherwise("G050"))
    return rounded(pipelines.communication(adapter.expression(spark, d), adapter.labels(spark, d), sig, z_cutoff=0.1, logfc_cutoff=0.001, lam=LAM, n_rand=PERMS), "activity_z")


@query()
def ccc_pairs(spark, d):
    sig = _self_named(spark, d)
    return rounded(pipelines.communication(adapter.expression(spark, d), adapter.labels(spark, d), sig, z_cutoff=0.5, logfc_cutoff=0.01, lam=LAM, n_rand=PERMS), "activity_z")


@query(sql("labels") + "SELECT a.t AS sender, b.t AS receiver FROM (SELECT DISTINCT cell_type AS t FROM labels) a JOIN (SELECT DISTINCT cell_type AS t FROM labels) b ON a.t <> b.t")
def sender_receiver(spark, d):
    t = adapter.labels(spark, d).select("cell_type").distinct()
    return pipelines.senders(t, t.select(F.col("cell_type").alias("receiver"))).select("sender", "receiver")


# --- frames, comparisons, results ---------------------------------------------------------------------------------------

_VALUES = "v AS (SELECT sample, sum(value) AS value FROM expr GROUP BY sample)"


def _totals(spark, d):
    return adapter.expression(spark, d).groupBy("sample").agg(F.sum("value").alias("value"))


@query(
    sql("expr", "labels")
    + f""", {_VALUES}, b AS (SELECT cell_type, count(*) AS n, min(value) AS least, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS most FROM v JOIN labels USING (sample) GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY median DESC, cell_type) AS INTEGER) AS place FROM b"""
)
def viz_celltype_box(spark, d):
    return frames.boxes(_totals(spark, d), adapter.labels(spark, d))


@query(sql("expr", "dense") + "SELECT gene, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), 6) AS detected FROM dense GROUP BY gene")
def viz_gene_stats(spark, d):
    return rounded(frames.gene_stats(adapter.expression(spark, d)), "mean", "detected")


@query(sql("labels") + "SELECT cell_type, count(*) AS n FROM labels GROUP BY 1")
def viz_celltype_counts(spark, d):
    return frames.type_counts(adapter.labels(spark, d))


@query("SELECT l_returnflag AS grp, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def viz_corr_fit(spark, d):
    out = frames.correlation(adapter.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_quantity", "l_extendedprice")
    return rounded(rounded(out, "slope", "r"), "intercept", digits=3)


@query(sql("expr") + f""", {_VALUES} SELECT sample, value, 'high' AS side FROM (SELECT * FROM v ORDER BY value DESC, sample LIMIT 15) UNION ALL SELECT sample, value, 'low' FROM (SELECT * FROM v ORDER BY value, sample LIMIT 15)""")
def viz_topn(spark, d):
    return frames.top_and_bottom(_totals(spark, d), "sample", "value")


@query(sql("spots") + "SELECT CAST(floor(x / 5.0) AS BIGINT) AS bx, CAST(floor(y / 5.0) AS BIGINT) AS by, count(*) AS n FROM spots GROUP BY 1, 2")
def viz_density(spark, d):
    return spatial.density(adapter.spots(spark, d), 5.0)


@query(sql("spots", "expr") + f", {_VALUES} SELECT sample, x, y, value FROM spots JOIN v USING (sample)")
def viz_spots(spark, d):
    return frames.scatter(adapter.spots(spark, d), _totals(spark, d))


@query(sql("expr", "dense") + "SELECT gene, round(var_pop(value), 6) AS variance FROM dense GROUP BY gene ORDER BY var_pop(value) DESC, gene LIMIT 50")
def viz_variable_genes(spark, d):
    return rounded(frames.most_variable(dense(spark, d)), "variance")


@query("""WITH v AS (SELECT feature, sample, max(CASE WHEN isnan(zscore) THEN NULL ELSE zscore END) AS z FROM activity GROUP BY feature, sample, run_id), o AS (SELECT DISTINCT sample, cell_type FROM obs WHERE cell_type IS NOT NULL)
SELECT feature, cell_type, round(avg(z), 6) + 0.0 AS value FROM v JOIN o USING (sample) GROUP BY 1, 2 HAVING avg(z) IS NOT NULL""")  # fmt: skip
def viz_heat_map(spark, d):
    a = adapter.table(spark, d, "activity").groupBy("feature", "sample", "run_id").agg(F.max(F.when(~F.isnan("zscore"), F.col("zscore"))).alias("zscore"))
    o = adapter.table(spark, d, "obs").where("cell_type is not null").select("sample", "cell_type").distinct()
    return rounded(frames.heat_map(a, o).where("value is not null"), "value")


_AB = """a AS (SELECT gene AS feature, sample, value AS va FROM treated), b AS (SELECT gene AS feature, sample, value AS vb FROM control),
j AS (SELECT *, abs(va - vb) AS d FROM a JOIN b USING (feature, sample))"""


@query(sql("treated", "control") + f""", {_AB} SELECT count(*) AS n, max(d) AS max_abs, round(avg(d), 6) AS mean_abs, round(sqrt(avg(d * d)), 6) AS rmse, round(corr(va, vb), 6) AS r,
(SELECT feature FROM j ORDER BY d DESC, feature DESC, sample DESC LIMIT 1) AS at_feature, (SELECT sample FROM j ORDER BY d DESC, feature DESC, sample DESC LIMIT 1) AS at_sample, max(d) <= 1e-10 AS within FROM j""")  # fmt: skip
def compare_metrics(spark, d):
    r, n = (adapter.expression(spark, d, f).withColumnsRenamed({"gene": "feature", "value": "zscore"}) for f in "RN")
    return rounded(compare.compare(r, n), "mean_abs", "rmse", "r")


@query(sql("treated", "control") + "SELECT gene, sample, value FROM treated UNION ALL SELECT gene, sample, value FROM control")
def concat_results(spark, d):
    return compare.concatenate(adapter.expression(spark, d, "R"), adapter.expression(spark, d, "N"))


@query("""WITH l AS (SELECT feature, sample, 'beta' AS metric, beta AS v FROM activity UNION ALL SELECT feature, sample, 'se', se FROM activity UNION ALL SELECT feature, sample, 'zscore', zscore FROM activity UNION ALL SELECT feature, sample, 'pvalue', pvalue FROM activity)
SELECT metric, count(*) AS n, min(v) AS least, round(avg(v), 6) + 0.0 AS mean, max(v) AS most, count(DISTINCT feature) AS features, count(DISTINCT sample) AS samples FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY metric""")  # fmt: skip
def result_summary(spark, d):
    return rounded(compare.summary(adapter.table(spark, d, "activity")), "mean")


@query("SELECT feature, sample, run_id, max(zscore) AS zscore FROM activity WHERE pvalue < 0.01 AND NOT isnan(pvalue) AND abs(zscore) > 2 AND NOT isnan(zscore) GROUP BY 1, 2, 3")
def significant_results(spark, d):
    a = compare.significant(adapter.table(spark, d, "activity").where("not isnan(pvalue) and not isnan(zscore)"), p=0.01, z=2.0)
    return a.groupBy("feature", "sample", "run_id").agg(F.max("zscore").alias("zscore"))


@query("SELECT 8.0 * 1170 * 7720 / 1073741824 AS projection_gb, 4.0 * 1000 * 7720 / 1073741824 AS permutations_gb, 8.0 * 7720 * 5000 / 1073741824 AS block_gb, 32.0 * 1170 * 5000 / 1073741824 AS results_gb")
def estimate_memory(spark, d):
    e = ridge.estimate_memory(7720, 1170, 100000, 1000, 5000)
    keys = ["projection_gb", "permutations_gb", "block_gb", "results_gb"]
    return spark.createDataFrame([tuple(e[k] for k in keys)], ", ".join(f"{k} double" for k in keys))
