"""The engine's operators against NumPy, brute force and each other."""

import gzip
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenact.functions.distributions import incomplete_beta, normal_p, t_two_sided
from lumenact.operators import compare, linalg, prep, ranks, ridge, rng, spatial, stats
from lumenact.plans import frames, pipelines
from lumenact.sources import results, tenx
from lumenact.sources.delimited import read_matrix, read_pairs, read_signature, sniff_index, sniff_separator
from lumenact.sources.signatures import Catalogue


def long(spark, m, genes, samples):
    return spark.createDataFrame([(g, s, float(m[i, j])) for i, g in enumerate(genes) for j, s in enumerate(samples) if m[i, j] != 0], "gene string, sample string, value double")


def sig_frame(spark, x, genes, features):
    return spark.createDataFrame([(g, f, float(x[i, j])) for i, g in enumerate(genes) for j, f in enumerate(features)], "gene string, feature string, weight double")


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(42)
    genes, samples, features = [f"g{i:03d}" for i in range(60)], [f"s{i:02d}" for i in range(9)], [f"f{i}" for i in range(5)]
    y = np.where(r.random((60, 9)) < 0.4, 0, r.lognormal(size=(60, 9)))
    x = r.normal(size=(60, 5))
    return genes, samples, features, y, x, long(spark, y, genes, samples), sig_frame(spark, x, genes, features)


def by_hand(x, y, lam, perms):
    t = np.linalg.inv(x.T @ x + lam * np.eye(x.shape[1])) @ x.T
    b = t @ y
    q = np.stack([t @ y[p] for p in perms])
    se = q.std(0)
    return b, se, (b - q.mean(0)) / se, ((np.abs(q) >= np.abs(b)).sum(0) + 1) / (len(perms) + 1)


def matrices(df):
    p = df.toPandas()
    return [p.pivot(index="feature", columns="sample", values=m).sort_index().sort_index(axis=1).to_numpy() for m in ("beta", "se", "zscore", "pvalue")]


def z(m):
    return (m - m.mean(0)) / m.std(0, ddof=1)


@pytest.mark.parametrize("method", rng.METHODS)
def test_ridge_matches_numpy(data, method):
    genes, _, _, y, x, expr, sig = data
    perms = rng.permutations(method, len(genes), 30, 0)
    yc = y - y.mean(1, keepdims=True)
    want = by_hand(z(x), z(yc), 10.0, perms)
    got = matrices(pipelines.activity(expr, sig, lam=10.0, n_rand=30, centre_rows=True, rng_method=method))
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w, atol=1e-10)


def test_ridge_is_the_same_however_it_runs(data):
    _, _, _, _, _, expr, sig = data
    base = matrices(pipelines.activity(expr, sig, lam=10.0, n_rand=20))
    for options in ({"batch_size": 2}, {"permutation_parts": 3}):
        for a, b in zip(base, matrices(pipelines.activity(expr.repartition(5), sig, lam=10.0, n_rand=20, **options)), strict=True):
            assert np.allclose(a, b, atol=1e-9)


@pytest.mark.parametrize("centre", [True, False])
@pytest.mark.parametrize("scale", [True, False])
def test_normalisation_in_flight(data, centre, scale):
    genes, _, _, y, x, expr, sig = data
    yy = y - (y.mean(0) if centre else 0)
    yy = yy / (y.std(0, ddof=1) if scale else 1)
    want = by_hand(z(x), yy, 3.0, rng.permutations("srand", len(genes), 10, 0))
    for g, w in zip(matrices(pipelines.activity(expr, sig, lam=3.0, n_rand=10, centre=centre, scale=scale)), want, strict=True):
        assert np.allclose(g, w, atol=1e-9)


def test_ttest_matches_numpy(data):
    _, _, _, y, x, expr, sig = data
    xs, ys = z(x), z(y)
    inv = np.linalg.inv(xs.T @ xs + 2 * np.eye(5))
    b = inv @ xs.T @ ys
    s2 = ((ys - xs @ b) ** 2).sum(0) / 55
    se = np.sqrt(np.diag(inv)[:, None] * s2)
    got = matrices(pipelines.activity(expr, sig, lam=2.0, n_rand=0))
    assert np.allclose(got[0], b) and np.allclose(got[1], se) and np.allclose(got[2], b / se)
    assert ((got[3] >= 0) & (got[3] <= 1)).all()


def test_activity_refuses_what_it_cannot_do(spark, data):
    _, _, _, _, _, expr, sig = data
    with pytest.raises(ValueError, match="genes in common"):
        pipelines.activity(expr.withColumn("gene", F.lit("none")), sig)
    with pytest.raises(ValueError):
        pipelines.activity(expr, sig, n_rand=-1)
    with pytest.raises(ValueError):
        pipelines.activity(expr, sig, rng_method="dice")
    with pytest.raises(ValueError):
        linalg.projection(np.eye(2), -1.0)


def test_grouped_features_come_back_one_by_one(spark, data):
    genes, _, features, _, x, expr, _ = data
    x = np.hstack([x, x[:, :1] * 2 + 1e-3])
    sig = sig_frame(spark, x, genes, [*features, "twin"])
    out = pipelines.activity(expr, sig, lam=1.0, n_rand=5, grouping=True).toPandas()
    assert set(out["feature"]) == {*features, "twin"}
    one = out.pivot(index="sample", columns="feature", values="beta")
    assert np.allclose(one["f0"], one["twin"])


def test_missing_values_count_as_zero(spark, data):
    genes, samples, _, y, _, expr, sig = data
    holes = spark.createDataFrame([("g000", "s00", None), ("g001", "s00", float("nan"))], "gene string, sample string, value double")
    clean = expr.where("not (sample = 's00' and gene in ('g000', 'g001'))")
    a, b = (matrices(pipelines.activity(e, sig, lam=1.0, n_rand=3)) for e in (clean, clean.unionByName(holes)))
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))


# --- generators -----------------------------------------------------------------------------------------------------


def test_words_of_the_generators():
    first = lambda it, n: [next(it) for _ in range(n)]
    assert first(rng.mt_words(5489), 2) == [3499211612, 581869302]
    assert first(rng.glibc_words(1), 3) == [1804289383, 846930886, 1681692777]
    assert first(rng.glibc_words(0), 3) == first(rng.glibc_words(1), 3)


def test_permutations_are_permutations_and_cumulative():
    for method in rng.METHODS:
        t = rng.permutations(method, 40, 6, 3)
        assert (np.sort(t, 1) == np.arange(40)).all()
        assert (np.take_along_axis(rng.inverse(t), t, 1) == np.arange(40)).all()
        assert not (t[0] == t[1]).all()
    assert (rng.permutations("srand", 40, 6, 3)[:3] == rng.permutations("srand", 40, 3, 3)).all()
    assert rng.chosen(None, True) == "srand" and rng.chosen(None, False) == "numpy" and rng.chosen("gsl") == "gsl"


# --- preparation ----------------------------------------------------------------------------------------------------


def test_statistics_without_zeros_equal_dense_ones(data):
    _, samples, _, y, _, expr, _ = data
    got = prep.population_stats(expr, 60, 9).toPandas().set_index("sample").loc[samples]
    c = y - y.mean(1, keepdims=True)
    assert np.allclose(got["mu"], c.mean(0)) and np.allclose(got["sigma"], c.std(0, ddof=1))
    got = prep.column_stats(expr, 60).toPandas().set_index("sample").loc[samples]
    assert np.allclose(got["mu"], y.mean(0)) and np.allclose(got["sigma"], y.std(0, ddof=1))


def test_empty_samples_stay_zero(spark):
    e = spark.createDataFrame([("a", "s", 0.0), ("b", "s", 0.0), ("a", "t", 2.0)], "gene string, sample string, value double")
    got = {(r.gene, r.sample): r.value for r in prep.log2p1(prep.scaled(e, 6.0)).collect()}
    assert got == {("a", "s"): 0.0, ("b", "s"): 0.0, ("a", "t"): math.log2(7)}
    assert all(r.value == 0 for r in prep.zscore_columns(e.where("sample = 's'")).collect())


def test_deduplication_keeps_the_best_and_the_first(spark):
    var = spark.createDataFrame([(0, "tp53.1"), (1, "TP53.2"), (2, "x.y.z"), (3, "X")], "pos int, gene_raw string")
    counts = spark.createDataFrame([(0, "s", 1.0), (1, "s", 5.0), (2, "s", 2.0), (3, "s", 2.0)], "pos int, sample string, value double")
    assert {(r.gene, r.value) for r in prep.deduplicate_genes(counts, var).collect()} == {("TP53", 5.0), ("X", 2.0)}
    kept = prep.keep_first(var.withColumn("gene", prep.standard_symbol("gene_raw")), "gene", ["pos"])
    assert {r.pos for r in kept.collect()} == {0, 2}


def test_differences(spark):
    t = spark.createDataFrame([("a", "1", 5.0), ("a", "2", 7.0), ("b", "1", 1.0)], "gene string, sample string, value double")
    c = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 3.0), ("z", "1", 1.0)], "gene string, sample string, value double")
    rows = lambda df: {(r.gene, r.sample): r.value for r in df.collect()}
    assert rows(prep.differential(t, c, aggregate=False)) == {("a", "1"): 3.0, ("a", "2"): 5.0}
    assert rows(prep.differential(t, c, is_paired=True, aggregate=False)) == {("a", "1"): 4.0, ("a", "2"): 4.0}
    assert rows(prep.differential(t, c)) == {("a", "differential"): 4.0}
    with pytest.raises(ValueError):
        prep.differential(t, is_paired=True)


def test_symbols_resolve_only_when_most_are_ids(spark):
    var = spark.createDataFrame([("ENSG1", "A"), ("ENSG2", "B"), ("C", "D")], "gene string, symbol string")
    assert {r.gene for r in prep.resolve_symbols(var).collect()} == {"A", "B", "D"}
    assert {r.gene for r in prep.resolve_symbols(var.where("gene <> 'ENSG1'")).collect()} == {"ENSG2", "C"}


def test_empty_tables_give_empty_results(spark):
    e = spark.createDataFrame([], "gene string, sample string, value double")
    for df in (prep.densify(e), prep.scaled(e), prep.centre_rows(e), prep.drop_zero_genes(e), prep.min_genes(e, 1), prep.collapse(e)):
        assert df.count() == 0
    assert prep.already_normalised(e).first().normalised is False


def test_non_numeric_columns_go(spark):
    w = spark.createDataFrame([("a", "1", "x"), ("b", "2.5", "y")], "gene string, s string, note string")
    assert prep.drop_non_numeric(w, ["gene"]).columns == ["gene", "s"]


# --- distributions, regressions -------------------------------------------------------------------------------------


def test_distribution_values():
    assert np.allclose(t_two_sided(np.array([0.0, 1.0, 2.0, 12.706]), 1), [1, 0.5, 0.2951672353, 0.05], atol=1e-5)
    assert abs(float(t_two_sided(np.array([2.228139]), 10)[0]) - 0.05) < 1e-6
    assert np.allclose(normal_p(np.array([0.0, 1.959964])), [1, 0.05], atol=1e-6)
    assert abs(incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-10


def test_spearman_with_ties(spark):
    p = pd.DataFrame({"k": ["a"] * 8, "x": [1, 2, 2, 3, 5, 8, 8, 9.0], "y": [2, 1, 4, 4, 3, 9, 7, 8.0]})
    want = p["x"].rank().corr(p["y"].rank())
    got = stats.spearman(spark.createDataFrame(p), ["k"], "x", "y").first()
    assert abs(got.r - want) < 1e-12 and got.n == 8 and 0 < got.p < 0.05


@pytest.mark.parametrize("alone", [ranks.ONE_TASK, 20])
def test_ranks_and_quantiles_of_any_group(spark, monkeypatch, alone):
    monkeypatch.setattr(ranks, "ONE_TASK", alone)
    r = np.random.default_rng(8)
    groups = {"ties": np.round(r.normal(size=900), 1), "wide": r.lognormal(size=500) * 1e3, "one": np.array([4.0]), "same": np.full(300, 2.0), None: np.array([1.0, 3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("ties", None), ("one", float("nan"))], "g string, v double")
    got = ranks.with_average_ranks(df, ["g"], {"v": "rank_"}).toPandas()
    for k, x in groups.items():
        own = got[got["g"] == k] if k else got[got["g"].isna()]
        assert len(own) == len(x) and np.allclose(own["rank_"], own["v"].rank())
    for row in ranks.quantiles(df, ["g"], "v", {"a": 0.25, "m": 0.5, "z": 1.0}).collect():
        assert row.n == len(groups[row.g]) and np.allclose([row.a, row.m, row.z], np.quantile(groups[row.g], [0.25, 0.5, 1.0]))
    assert ranks.quantiles(df.limit(0), [], "v", {"m": 0.5}).first().n is None


def test_kaplan_meier_by_hand(spark):
    rows = [("g", "a", 1.0, 1), ("g", "b", 2.0, 0), ("g", "c", 3.0, 1), ("g", "d", 4.0, 1)]
    got = [round(r.survival, 6) for r in stats.kaplan_meier(spark.createDataFrame(rows, "grp string, sample string, time double, event int"), "grp").orderBy("time").collect()]
    assert got == [0.75, 0.75, 0.375, 0.0]


def newton(x, y, firth):
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        w = p * (1 - p)
        inv = np.linalg.inv((x * w[:, None]).T @ x)
        h = w * np.einsum("ij,jk,ik->i", x, inv, x)
        b = b + inv @ (x.T @ (y - p - (h * (p - 0.5) if firth else 0)))
    return b, np.sqrt(np.diag(inv))


@pytest.mark.parametrize("firth", [False, True])
def test_logistic_regression(spark, firth):
    r = np.random.default_rng(1)
    x = np.hstack([np.ones((80, 1)), r.normal(size=(80, 2))])
    y = (r.random(80) < 1 / (1 + np.exp(-x @ [0.3, 1.0, -0.5]))).astype(float)
    df = spark.createDataFrame(pd.DataFrame(np.hstack([x, y[:, None]]), columns=["a", "b", "c", "y"]))
    fit = stats.logistic_regression(df, "y", ["a", "b", "c"], firth=firth)
    b, se = newton(x, y, firth)
    assert fit["converged"] and np.allclose(fit["beta"], b, atol=1e-6) and np.allclose(fit["se"], se, atol=1e-6)


def test_singular_logistic_regression(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0)], "x double, y int")
    fit = stats.logistic_regression(df, "y", ["x"])
    assert not fit["converged"] and fit["p"][0] == 1


def test_cox_finds_the_hazard(spark):
    r = np.random.default_rng(3)
    act = r.normal(size=200)
    rows = [("f", float(r.exponential(np.exp(-a))), 1, float(a)) for a in act] + [("few", 1.0, 1, 1.0)] * 3 + [("flat", float(i), 1, 2.0) for i in range(9)] + [("alive", float(i), 0, float(i)) for i in range(9)]
    got = stats.cox(spark.createDataFrame(rows, "feature string, time double, event int, act double"), "feature", "time", "event", ["act"]).collect()
    assert [g.feature for g in got] == ["f"] and got[0].risk_score_z > 5 and got[0].p_value < 1e-6


def test_nmf_recovers_a_product():
    r = np.random.default_rng(0)
    v = r.random((12, 2)) @ r.random((2, 15))
    w, h, err = stats.nmf(v, 2)
    assert err < 1e-2 and (w >= 0).all() and (h >= 0).all()


# --- neighbourhoods, comparisons ---------------------------------------------------------------------------------------


def test_radius_pairs_equal_brute_force(spark):
    r = np.random.default_rng(2)
    xy = r.normal(size=(70, 2)) * 10
    xy[1] = xy[0]
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(xy)], "sample string, x double, y double")
    want = {(str(i), str(j)) for i in range(70) for j in range(70) if i != j and np.hypot(*(xy[i] - xy[j])) <= 4}
    assert {(p.a, p.b) for p in spatial.radius_pairs(df, 4.0).collect()} == want
    sums = spatial.weights(df, 4.0, 2.0).groupBy("a").agg(F.sum("w").alias("s")).collect()
    assert all(abs(s.s - 1) < 1e-12 for s in sums)


def test_patterns(spark):
    act = spark.createDataFrame([(f"f{i}", f"s{j}", float((i % 2 == j % 2) * (i + 1))) for i in range(4) for j in range(6)], "feature string, sample string, value double")
    corr = spark.createDataFrame([(f"f{i}", 0.01) for i in range(4)], "feature string, p double")
    w, h, k = spatial.patterns(act, corr, [1, 2])
    assert k == 2 and w.count() == 8 and h.count() == 12
    assert spatial.patterns(act, corr.where("feature = 'f0'"), 2) is None
    genes = [r.feature for p in "12" for r in spatial.pattern_genes(w, p).collect()]
    assert sorted(genes) == ["f0", "f1", "f2", "f3"]


def test_comparison_verdict(spark):
    a = spark.createDataFrame([("f", "s", 1.0), ("g", "s", 2.0), ("only", "s", 0.0)], "feature string, sample string, zscore double")
    b = spark.createDataFrame([("f", "s", 1.0), ("g", "s", 2.5)], "feature string, sample string, zscore double")
    row = compare.compare(a, b).first()
    assert (row.n, row.max_abs, row.at_feature, row.within) == (2, 0.5, "g", False)
    assert compare.compare(a, a).first().within
    assert [r.feature for r in compare.missing(a, b).collect()] == ["only"]


def test_communication(spark, data):
    genes, samples, _, y, x, expr, _ = data
    sig = sig_frame(spark, x, genes, genes[:5])
    obs = spark.createDataFrame([(s, "AB"[i % 2]) for i, s in enumerate(samples)], "sample string, cell_type string")
    got = pipelines.communication(expr, obs, sig, z_cutoff=0.0, logfc_cutoff=0.0, fraction_cutoff=0.0, lam=1.0, n_rand=10).collect()
    assert got and all(r.sender != r.receiver and r.secretedProtein in genes[:5] for r in got)
    cond = obs.withColumn("condition", F.when(F.col("sample") < "s05", "t").otherwise("c"))
    pipelines.communication(expr, cond, sig, "t", "c", z_cutoff=0.0, least_cells=1, lam=1.0, n_rand=5).collect()


def test_frames(spark):
    v = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "sample string, value double")
    t = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "sample string, cell_type string")
    assert [(r.cell_type, r.n) for r in frames.boxes(v, t).orderBy("place").collect()] == [("y", 1), ("x", 1)]
    assert frames.top_and_bottom(v.dropna(), "sample", "value", 15).count() == 4
    one = spark.createDataFrame([("f", "s", 1.0)], "feature string, sample string, value double")
    assert [r.label for r in frames.distribution({"10": one, "0": one}, "f").orderBy("radius").collect()] == ["Target", "10"]


# --- files --------------------------------------------------------------------------------------------------------------


def test_separators_and_index():
    assert sniff_separator(["a\tb", "1\t2"]) == "\t" and sniff_separator(["a,b"]) == "," and sniff_separator(["a b"]) == r"\s+"
    assert sniff_index([["g", "s"], ["A", "1"]]) == 0 and sniff_index([["a", "b"], ["1", "2"]]) is None and sniff_index([["a"]]) is None


@pytest.mark.parametrize("text", ["gene\ts1\tnote\ts2\nA\t1\tx\t2\nB\t3\ty\tbad\nA\t9\tz\t9\n", "gene,s1,note,s2\nA,1,x,2\nB,3,y,bad\nA,9,z,9\n", "s1 note s2\nA 1 x 2\nB 3 y bad\nA 9 z 9\n"])
def test_matrix_files(spark, tmp_path, text):
    (tmp_path / "m.txt").write_text(text)
    got = {(r.gene, r.sample): r.value for r in read_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {("A", "s1"): 1.0, ("A", "s2"): 2.0, ("B", "s1"): 3.0, ("B", "s2"): None}


def test_empty_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("")
    assert read_matrix(spark, str(tmp_path / "m.csv")).count() == 0


def test_signature_catalogue(spark, tmp_path):
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write("\tT__IL2\tT__IL4\tB__IL2\nA\t1\t\t3\nB\t4\t5\t6\n")
    c = Catalogue(spark, {"Own": str(tmp_path / "s.tsv.gz")})
    assert {(r.gene, r.feature): r.weight for r in c.load("OWN").collect()}[("A", "T__IL4")] == 0.0
    with pytest.warns(UserWarning):
        got = c.load("own", features=["B__IL2", "none", "T__IL2"]).orderBy("feature_pos", "gene").collect()
    assert [r.feature for r in got] == ["B__IL2"] * 2 + ["T__IL2"] * 2
    assert {r.feature for r in c.load_stratified("own", cell_types=["T"], cytokines=["IL4"]).collect()} == {"T__IL4"}
    with pytest.raises(ValueError):
        c.load_stratified("own", cell_types=["none"])
    assert c.info("own").first().n_features == 3 and c.names() == ["own"]
    assert read_signature(spark, str(tmp_path / "s.tsv.gz")).count() == 6


def test_ligand_receptor_pairs(spark, tmp_path):
    (tmp_path / "lr.tsv").write_text("Ligand.ApprovedSymbol\tReceptor.ApprovedSymbol\tx\nA\tB\t1\nA\tB\t2\n")
    assert [(r.ligand, r.receptor) for r in read_pairs(spark, str(tmp_path / "lr.tsv")).collect()] == [("A", "B")]


def test_folder_of_counts(spark, tmp_path):
    files = {"features.tsv.gz": "id1\tG1\nid2\tG2\n", "barcodes.tsv.gz": "AA\nBB\nCC\n", "matrix.mtx.gz": "%%MatrixMarket\n2 3 4\n1 1 5\n2 1 1\n1 2 7\n2 3 2\n"}
    for name, text in files.items():
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    (tmp_path / "pos.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col\nAA,1,0,1,10,20\nBB,0,1,1,1,1\nCC,1,2,3,30,40\n")
    (tmp_path / "scale.json").write_text(json.dumps({"spot_diameter": 2.0}))
    got = tenx.read_folder(spark, str(tmp_path), positions=str(tmp_path / "pos.csv"), scale_factors=str(tmp_path / "scale.json"))
    assert {(r.gene, r.sample): r.value for r in got["counts"].collect()} == {("G1", "0x1"): 5.0, ("G2", "0x1"): 1.0, ("G2", "2x3"): 2.0}
    assert got["scale_factors"] == {"tissue_lowres_scalef": 1.0, "spot_diameter": 2.0}
    got = tenx.read_folder(spark, str(tmp_path), min_genes=2)
    assert {r.sample for r in got["spots"].collect()} == {"AA"}


def test_results_round_trip(spark, data, tmp_path):
    _, _, _, _, _, expr, sig = data
    out = pipelines.activity(expr, sig, lam=1.0, n_rand=5).persist()
    for name in ("r.parquet", "r.csv", "r"):
        results.save(out, str(tmp_path / name))
        assert compare.compare(out, results.load(spark, str(tmp_path / name))).first().max_abs < 1e-12
    results.append_batch(out, str(tmp_path / "r"))
    assert results.info(spark, str(tmp_path / "r")).first().rows == 2 * out.count()
    results.save_matrices(out, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m_zscore"), header=True).count() == 5
    results.save_bundle(str(tmp_path / "b"), counts=expr, activity=out)
    assert results.load_bundle(spark, str(tmp_path / "b"), "counts")["counts"].count() == expr.count()
    obs = spark.createDataFrame([("s00",), ("none",)], "sample string")
    assert {r.sample: r.activity_zscore is None for r in compare.attach(obs, out).collect()} == {"s00": False, "none": True}


def test_command_line(spark, data, tmp_path):
    from lumenact.cli import main

    _, _, _, _, _, expr, sig = data
    expr, sig = (t.withColumn("gene", F.upper("gene")) for t in (expr, sig))  # counts go by standard symbols
    path = lambda name: str(tmp_path / name)
    expr.write.parquet(path("e.parquet"))
    wide = sig.groupBy("gene").pivot("feature").agg(F.first("weight")).toPandas()
    wide.to_csv(path("s.tsv"), sep="\t", index=False)
    rest = ["-s", path("s.tsv"), "-n", "5", "--lambda", "1"]
    base = ["-i", path("e.parquet"), *rest]
    assert main(["bulk", *base, "-o", path("a.parquet"), "--sort-genes", "--use-cache", "-v"]) == 0
    assert main(["bulk", *base, "--batch-size", "3", "-o", path("b.parquet"), "-q", "--backend", "numpy"]) == 0
    assert main(["compare", path("a.parquet"), path("b.parquet"), "-t", "1e-9"]) == 0
    assert main(["cosmx", *base, "--no-sig-filter", "--min-genes", "1", "-o", path("c.parquet")]) == 0
    assert main(["compare", path("a.parquet"), path("c.parquet")]) == 1
    assert main(["convert", "-i", path("a.parquet"), "-o", path("a.csv")]) == 0
    assert main(["inspect", "-i", path("a.parquet"), "-v"]) == 0
    # the same table with samples and genes changed over
    expr.select(F.col("sample").alias("gene"), F.col("gene").alias("sample"), "value").write.parquet(path("t.parquet"))
    assert main(["bulk", "-i", path("t.parquet"), *rest, "--transpose", "-o", path("d.parquet")]) == 0
    assert main(["compare", path("a.parquet"), path("d.parquet"), "-t", "1e-9"]) == 0
    # other names of the samples: only their places agree
    renamed = spark.read.parquet(path("a.parquet")).withColumn("sample", F.concat(F.lit("x"), "sample"))
    renamed.write.parquet(path("f.parquet"))
    assert main(["compare", path("a.parquet"), path("f.parquet")]) == 1
    assert main(["compare", path("a.parquet"), path("f.parquet"), "--by-position"]) == 0
    renamed.where("feature <> 'f1'").write.parquet(path("g.parquet"))
    assert main(["compare", path("a.parquet"), path("g.parquet"), "--by-position"]) == 1
    # only what both have, if asked
    spark.read.parquet(path("a.parquet")).where("feature <> 'f1'").write.parquet(path("h.parquet"))
    assert main(["compare", path("a.parquet"), path("h.parquet")]) == 1
    assert main(["compare", path("a.parquet"), path("h.parquet"), "--sort"]) == 0
    # a bundle with cell types
    counts = expr.withColumn("value", F.abs(F.round("value") * 3))
    obs = expr.select("sample").distinct().withColumn("CellType", F.when(F.col("sample") < "s05", "b").otherwise("A"))
    results.save_bundle(path("bundle"), counts=counts, obs=obs)
    assert main(["scrnaseq", "-i", path("bundle"), *rest, "-o", path("i.parquet")]) == 0
    assert main(["visium", "-i", path("bundle"), *rest, "--min-genes", "1", "-c", "CellType", "--no-spot-level", "-o", path("j.parquet")]) == 0
    for name in ("i.parquet", "j.parquet"):
        assert {r.sample for r in spark.read.parquet(path(name)).select("sample").distinct().collect()} == {"A", "b"}
    wide = compare.wide(spark.read.parquet(path("i.parquet")), "zscore")
    assert wide.columns == ["feature", "A", "b"] and [r.feature for r in wide.collect()] == sorted({r.feature for r in sig.collect()})
    with pytest.raises(SystemExit):
        main(["scrnaseq", "-i", path("bundle"), *rest, "-c", "none", "-o", path("k.parquet")])


def test_pipelines_go_by_standard_symbols(spark, data):
    """Copies of a symbol: the gene with the highest total stays, whatever the order of the rows."""
    _, _, _, _, _, expr, sig = data
    counts = expr.withColumn("value", F.abs(F.round("value") * 3) + 1)
    low = counts.withColumn("gene", F.concat("gene", F.lit(".2"))).withColumn("value", F.col("value") * 0.25)
    sig = sig.withColumn("gene", F.upper("gene"))
    labels = counts.select("sample").distinct().withColumn("cell_type", F.substring("sample", 3, 1))
    options = {"lam": 1.0, "n_rand": 5}
    want = matrices(pipelines.single_cell(counts.withColumn("gene", F.upper("gene")), sig, per_cell=True, symbols=False, **options))
    assert np.allclose(matrices(pipelines.single_cell(low.unionByName(counts), sig, per_cell=True, **options)), want)
    assert np.allclose(matrices(pipelines.spatial(counts.unionByName(low).withColumn("value", F.col("value")), sig, **options)), want)
    # normalised values are averaged, counts are summed
    fine = counts.withColumn("value", F.col("value") / 7)
    both = [matrices(pipelines.single_cell(t, sig, labels, **options)) for t in (fine, counts)]
    by_hand = [matrices(pipelines.single_cell(t, sig, labels, normalised=n, **options)) for t, n in ((fine, True), (counts, False))]
    assert np.allclose(both, by_hand) and not np.allclose(by_hand[0], by_hand[1])


def test_the_order_of_genes_moves_the_null(spark, data):
    _, _, _, _, _, expr, sig = data
    placed = expr.withColumn("pos", F.xxhash64("gene"))
    a, b, c = (pipelines.bulk(t, sig, lam=1.0, n_rand=7, order=o) for t, o in ((placed, "expression"), (placed, "sorted"), (expr, "expression")))
    a, b, c = (matrices(t) for t in (a, b, c))
    assert np.allclose(a[0], b[0]) and not np.allclose(a[1], b[1]) and np.allclose(b, c)


def test_repeated_rows_of_a_gene_and_a_sample(spark, data):
    _, _, _, _, _, expr, sig = data
    lower = expr.withColumn("value", F.col("value") - 5)
    want = matrices(pipelines.activity(expr, sig, lam=1.0, n_rand=5, centre_rows=True))
    for t in (lower.unionByName(expr), expr.unionByName(lower)):
        assert np.allclose(matrices(pipelines.activity(t, sig, lam=1.0, n_rand=5, centre_rows=True)), want)


def test_a_given_projection_and_described_runs(spark, data):
    genes, _, features, y, x, expr, sig = data
    t = linalg.projection(z(x), 1.0)
    want = matrices(pipelines.activity(expr, sig, lam=1.0, n_rand=6, centre=False, scale=False))
    assert np.allclose(matrices(pipelines.with_projection(expr, t, genes, features, n_rand=6)), want)
    with pytest.raises(NotImplementedError):
        pipelines.with_projection(expr, t, genes, features, n_rand=0)
    with pytest.raises(ValueError):
        pipelines.with_projection(expr, t[:, :3], genes, features)
    with pytest.raises(ValueError):
        pipelines.activity(expr, sig, backend="cupy")
    out, about = pipelines.described(expr, sig, lam=1.0, n_rand=6)
    assert about["n_genes"] == len(genes) and about["n_features"] == len(features) and about["method"] == "permutation" and out.count() == len(features) * y.shape[1]
    rows, order = pipelines.prepare(expr, sig)
    assert sorted(order) == sorted(genes) and np.isclose(rows.where("sample = 's01'").agg(F.stddev_samp("value")).first()[0], 1)
    with pytest.raises(ValueError):
        pipelines.prepare(expr.where(F.col("gene").isin(genes[:3])), sig)


def test_factors_in_blocks_are_as_good_as_those_of_the_driver(spark, monkeypatch):
    r = np.random.default_rng(5)
    truth = r.gamma(1.0, size=(12, 2)) @ r.gamma(1.0, size=(2, 80)) + r.random((12, 80)) * 0.05
    act = long(spark, truth, [f"g{i:02d}" for i in range(12)], [f"s{i:02d}" for i in range(80)]).withColumnRenamed("gene", "feature")
    found = spark.createDataFrame([(f"g{i:02d}", 0.0) for i in range(12)], "feature string, p double")
    errors = []
    for limit in (spatial.DRIVER_VALUES, 0):
        monkeypatch.setattr(spatial, "DRIVER_VALUES", limit)
        w, h, k = spatial.patterns(act, found, [2])
        w = w.toPandas().pivot(index="feature", columns="pattern", values="weight").to_numpy()
        h = h.toPandas().pivot(index="pattern", columns="sample", values="weight").to_numpy()
        assert k == 2 and w.min() >= 0 and h.min() >= 0 and h.shape == (2, 80)
        errors.append(np.linalg.norm(truth - w @ h))
    assert errors[1] < 1.05 * errors[0] < 0.05 * np.linalg.norm(truth)


def test_generators_and_stored_tables(tmp_path):
    for method in rng.METHODS:
        g = rng.Generator(method, 3)
        assert (g.permutations(9, 4) == rng.permutations(method, 9, 4, 3)).all() and 0 <= g.below(5) < 5 and 0 <= g.word() <= g.most
        for inverted in (False, True):
            want = rng.permutations(method, 9, 4, 3)
            want = rng.inverse(want) if inverted else want
            for _ in range(2):
                assert (rng.stored(str(tmp_path), method, 9, 4, 3, inverted) == want).all()
    assert len(list(tmp_path.iterdir())) == 6
    with pytest.raises(ValueError):
        rng.Generator("dice")


def test_signatures_of_a_folder(spark, tmp_path):
    (tmp_path / "First.tsv").write_text("gene\tf\nA\t1\nB\t2\n")
    (tmp_path / "notes.md").write_text("none")
    c = Catalogue(spark)
    assert c.register_folder(str(tmp_path)) == ["first"]
    assert {(r.gene, r.weight) for r in c.load_first(genes=["B"]).collect()} == {("B", 2.0)}
    with pytest.raises(AttributeError):
        c.load_second()


def test_streams(spark, data, tmp_path):
    from lumenact.streaming import incremental

    genes, _, features, y, x, expr, sig = data
    idx = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, idx int")
    ridge.sample_rows(expr, idx).repartition(3).write.parquet(str(tmp_path / "in"))
    kernel = ridge.Kernel(linalg.projection(z(x), 1.0), rng.permutations("srand", 60, 5, 0))
    seen = []
    stream = spark.readStream.schema("sample string, idx array<int>, val array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.write_results(incremental.activity_of_blocks(stream, kernel, features), str(tmp_path / "out"), str(tmp_path / "ck"), seen.append).awaitTermination()
    want = matrices(pipelines.activity(expr, sig, lam=1.0, n_rand=5))
    assert seen and np.allclose(matrices(spark.read.parquet(str(tmp_path / "out")))[2], want[2])
    expr.write.parquet(str(tmp_path / "rows"))
    sums = incremental.running_stats(spark.readStream.schema(expr.schema).parquet(str(tmp_path / "rows")))
    q = sums.writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sums").count() == 9


def test_memory_and_batch_estimates():
    assert 100 <= ridge.estimate_batch_size(7720, 1170, 0.1) <= 50000
    assert ridge.estimate_memory(7720, 1170, 1000)["total_gb"] > 0


def test_small_helpers(spark):
    assert prep.find_column(["Time", "EVENT"], ["os", "event", "time"]) == "EVENT" and prep.find_column(["a"], ["b"]) is None
    e = spark.createDataFrame([("a", "x", 1.0)], "gene string, sample string, value double")
    assert prep.name_single(e).first().sample == "Change"
    assert {r.sample for r in prep.name_single(e.unionByName(e.withColumn("sample", F.lit("y")))).collect()} == {"x", "y"}
    with pytest.raises(ImportError):
        pipelines.spatial_communication()


def test_gene_order_is_a_choice(spark, data):
    genes, _, _, _, _, expr, sig = data
    turned = sig.join(spark.createDataFrame([(g, -i) for i, g in enumerate(genes)], "gene string, pos int"), "gene")
    assert pipelines.common_genes(expr, turned, "signature") == genes[::-1]
    assert pipelines.common_genes(expr, sig) == genes
    a, b = (matrices(pipelines.activity(expr, turned, lam=1.0, n_rand=10, order=o)) for o in ("sorted", "signature"))
    assert np.allclose(a[0], b[0]) and not np.allclose(a[2], b[2])
    with pytest.raises(ValueError):
        pipelines.common_genes(expr, sig, "random")
