"""The operators of the subpackage against brute force, exact round trips and defined edge cases."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenact.llm import balls, bisection, bytebpe, common, mixture, packing, similar, splitting, topn, varied
from lumenact.llm.cftree import leaf_entries, ward
from lumenact.llm.profiles import cells, profiles
from lumenact.llm.queries import vocabulary_path

tokenized = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary here")


def points(spark, x, names=None, labels=None):
    rows = [(names[i] if names else f"c{i:05d}", labels[i] if labels else None, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample string, annotation string, vec array<double>").repartition(5)


def cloud(seed, n=240, d=6):
    """Tight groups, stretched chains, lonely points and copies."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d)) * 4
    x = np.vstack([centres[r.integers(0, 6, n // 2)] + r.normal(size=(n // 2, d)) * 0.4, np.cumsum(r.normal(size=(n // 4, d)), 0), r.normal(size=(n // 8, d)) * 12])
    return np.vstack([x, np.repeat(x[:1], n - len(x), 0)])


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


# --- profiles and labels -----------------------------------------------------------------------------------------------


def test_profiles_and_labels(spark):
    panel = spark.createDataFrame([("B", 1, "core"), ("A", 0, "core"), ("X", 2, "ext")], "feature string, pos int, tier string")
    nan = float("nan")
    act = [("A", "c1", 1.0, 1), ("A", "c1", 1.0, 1), ("B", "c1", None, 1), ("B", "c2", nan, 1), ("A", "c2", -2.0, 1), ("A", "c2", -1.0, 2), ("X", "c3", 5.0, 1), ("A", None, 1.0, 1), ("A", "bulk", 9.0, 1)]
    act = spark.createDataFrame(act, "feature string, sample string, zscore double, run_id long").withColumn("vec", F.lit("clash")).withColumn("_at", F.lit(1)).withColumn("v0", F.lit(0))
    obs = spark.createDataFrame([("c1", " Naive_ -resting\t"), ("c1", "naive resting"), ("c2", "N/A"), ("c3", None), (None, "x"), ("absent", "y")], "sample string, annotation string").withColumn("pos", F.lit(7))
    got = {r.sample: (r.annotation, list(r.vec)) for r in profiles(act, obs, panel, "zscore").collect()}
    assert got == {"c1": ("naive resting", [1.0, 0.0]), "c2": (None, [-1.0, 0.0]), "c3": (None, [0.0, 0.0])}
    assert profiles(act.limit(0), obs, panel, "zscore").count() == 0
    assert {r.sample for r in cells(obs).collect()} == {"c1", "c2", "c3", "absent"}


# --- problem 1 -----------------------------------------------------------------------------------------------------------


def test_entries_add_up(spark):
    x = cloud(0)
    tree = leaf_entries(points(spark, x), 0.5, 1.0, 20).to_pandas()
    assert len(tree) <= 20 and tree["n"].sum() == len(x)
    assert np.allclose(np.stack(tree["ls"]).sum(0), x.sum(0)) and np.isclose(tree["ss"].sum(), (x**2).sum())


def test_ward_joins_the_nearest():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [50.0]])
    assert ward(np.ones(5), x, 3).tolist() == [0, 0, 1, 1, 2]
    blocks = ward(np.ones(5), x, 3, np.array([0, 1, 1, 1, 0]))
    assert len(set(blocks)) == 3 and blocks[0] != blocks[1]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("t", [0.5, 2.0, 6.0])
def test_sparse_points_equal_brute_force(spark, seed, t):
    x = cloud(seed)
    want = {f"c{i:05d}" for i in np.flatnonzero((dist(x) <= t).sum(1) - 1 <= 4)}
    assert {r.sample for r in varied.sparse_points(points(spark, x), t, 4).collect()} == want


def test_sparse_points_do_not_depend_on_pivots(spark):
    x = cloud(3)
    want = {f"c{i:05d}" for i in np.flatnonzero((dist(x) <= 2).sum(1) - 1 <= 4)}
    for pivots in (x[:1], x[5:9] + 30, np.zeros((3, 6))):
        assert {r.sample for r in balls.lonely(points(spark, x), pivots, 2.0, 4).collect()} == want


def test_varied_subset_covers_labels_and_kinds(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(300, 4)), r.normal(size=(6, 4)) + 40, r.normal(size=(4, 4)) - 40])
    labels = ["big"] * 300 + ["small"] * 6 + [None] * 4
    got = varied.varied_subset(points(spark, x, labels=labels), 5, radius=1.0).collect()
    assert len(got) == 5 and {g.annotation for g in got} == {"big", "small", None}
    assert sum(g.grp_size for g in got) == 310
    assert varied.varied_subset(points(spark, x[:3], labels=labels[:3]), 10, radius=1e-3).count() == 3
    assert varied.varied_subset(points(spark, np.ones((5, 4))), 4).count() == 1
    assert varied.varied_subset(points(spark, np.zeros((0, 4))), 4).count() == 0
    with pytest.raises(ValueError):
        varied.varied_subset(points(spark, x), 0)


def test_more_labels_than_places(spark):
    x = np.vstack([np.zeros((30, 3)), np.ones((30, 3)) * 50])
    got = varied.varied_subset(points(spark, x, labels=[f"l{i}" for i in range(60)]), 4, radius=1.0, kind=5.0).collect()
    assert len(got) == 2 and sum(g.grp_size for g in got) == 60


def test_shared_folder_and_release(spark, tmp_path):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    out = common.written(spark.range(5).toDF("x"))
    path = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert out.count() == 5 and os.path.isdir(path)
    common.release()
    assert not os.path.isdir(path)


def test_varied_subset_gives_every_kind_a_place(spark):
    r = np.random.default_rng(2)
    kinds = np.vstack([np.arange(6)[:, None] * np.full((1, 4), 3.0), r.normal(size=(15, 4)) * 1000])  # 6 near each other
    truth = np.concatenate([np.repeat(np.arange(6), 8), np.tile(np.arange(6, 21), 8)])  # far ones under two labels
    labels = ["a"] * 48 + ["b"] * 60 + ["c"] * 60
    x = kinds[truth] + r.normal(size=(168, 4)) * 0.02
    got = varied.varied_subset(points(spark, x, labels=labels), 24, radius=0.2, kind=1.0).collect()
    assert len(got) == 24 and sum(g.grp_size for g in got) == 168
    assert {truth[int(g.sample[1:])] for g in got} == set(range(21))


# --- problem 2 -----------------------------------------------------------------------------------------------------------


def test_percentiles_are_exact(spark):
    r = np.random.default_rng(5)
    frames = {"flat": np.full(500, 2.5), "many": r.normal(size=3000) * 1e3, "few": np.array([3.0]), "ties": np.round(r.normal(size=999), 1), "wide": np.array([-1.7e308, 0.0, 5e-324, 1.7e308]), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in frames.items() for v in x] + [("many", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("pct", F.lit(1)).withColumn("lo", F.lit(2))
    got = {(x.g, x.pct): (x.value, x.n) for x in bisection.percentiles(df, ["g"], [1, 50, 75, 90, 100]).collect()}
    want = {(k, p): (float(np.sort(x)[max(1, -(-p * len(x) // 100)) - 1]), len(x)) for k, x in frames.items() for p in (1, 50, 75, 90, 100)}
    assert got == want
    assert bisection.percentiles(df.limit(0), ["g"], [50]).count() == 0


def test_summaries_of_parts_combine(spark):
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=4000) * 3, 3)
    df = spark.createDataFrame([("a", int(i % 7), float(v)) for i, v in enumerate(x)] + [("a", 1, None), ("a", 1, float("nan"))], "g string, day int, v double")
    days = bisection.summaries(df, ["g", "day"])
    both = bisection.combine(days, ["g"])
    assert {(q.cell, q["count"]) for q in both.collect()} == {(q.cell, q["count"]) for q in bisection.summaries(df, ["g"]).collect()}
    for row in bisection.from_summary(both, ["g"], [50, 75, 90]).collect():
        assert row.rank_error <= 0.01 and row.n == 4000
        assert abs((x <= row.value).mean() - row.pct / 100) <= row.rank_error + 1 / 4000


def test_combined_percentiles_keep_the_bound_in_narrow_and_thin_groups(spark):
    r = np.random.default_rng(7)
    groups = {"narrow": r.normal(size=900) * 0.01, "thin": r.normal(size=40), "tied": np.round(r.normal(size=700), 1) + r.choice([0, 1e-9], 700), "one": np.full(300, 2.0), None: np.array([1.0, 1.001])}
    df = spark.createDataFrame([(k, i % 5, float(v)) for k, x in groups.items() for i, v in enumerate(x)], "g string, day int, v double")
    days = bisection.summaries(df, ["g", "day"])
    early = bisection.combine(days.where("day < 2"), ["g"])
    for both in (bisection.combine(days, ["g"]), bisection.combine(early.unionByName(bisection.combine(days.where("day >= 2"), ["g"])), ["g"])):
        got = bisection.from_summary(both, ["g"], [1, 50, 75, 90, 100]).collect()
        assert len(got) == 5 * len(groups)
        for row in got:
            x = groups[row.g]
            rank = max(1, -(-row.pct * len(x) // 100))
            assert row.n == len(x) and row.rank_error <= 0.01 and row.value in x
            assert (x < row.value).sum() - 0.01 * len(x) < rank <= (x <= row.value).sum()


# --- problem 4 -----------------------------------------------------------------------------------------------------------


def test_top_results_under_ties(spark):
    nan = float("nan")
    rows = [("s", "b", 1, 2.0, 0.5), ("s", "b", 1, 2.0, 0.5), ("s", "a", 1, 2.0, 0.5), ("s", "B", 1, 2.0, 0.5), ("s", "a", 0, 2.0, 0.5), ("s", "z", 1, 2.0, 0.1), ("s", "n", 1, 2.0, None), ("s", "m", 1, 2.0, nan), ("s", "x", 1, nan, 0.0), ("s", "y", 1, None, 0.0), ("t", "a", 1, 1.0, None), (None, "a", 1, 1.0, 0.2)]
    df = spark.createDataFrame(rows, "sample string, feature string, run_id long, zscore double, pvalue double").withColumn("rank_no", F.lit(0))
    got = [(r.feature, r.run_id) for r in topn.top_results(df, 7).where("sample = 's'").orderBy("rank_no").collect()]
    assert got == [("z", 1), ("B", 1), ("a", 0), ("a", 1), ("b", 1), ("m", 1), ("n", 1)]
    assert topn.top_results(df, 1).count() == 3
    assert topn.top_results(df.limit(0), 3).count() == 0


def test_the_group_limit_is_on_both_sides_of_the_shuffle(spark):
    df = spark.range(1000).selectExpr("string(id % 3) as g", "double(id) as v").repartition(3)
    plan = topn.top_n(df, ["g"], [F.col("v").desc()], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


# --- problem 3 -----------------------------------------------------------------------------------------------------------


def first_of_chain(x, t):
    near, first = dist(x) <= t, np.arange(len(x))
    while True:
        again = np.array([first[row].min() for row in near])
        if (again == first).all():
            return first
        first = again


@pytest.mark.parametrize(("seed", "t"), [(1, 0.7), (2, 2.0), (3, 5.0)])
def test_chains_equal_brute_force(spark, seed, t):
    x = cloud(seed, 200)
    want = {(f"c{i:05d}", f"c{f:05d}") for i, f in enumerate(first_of_chain(x, t))}
    assert {(r.sample, r.first) for r in mixture.linked(points(spark, x), t).collect()} == want
    for pivots in (x[:2], x[::5]):
        assert {(r.sample, r.first) for r in balls.chains(points(spark, x), pivots, t).collect()} == want


def test_links_of_a_dense_group_are_fewer_than_its_rows(spark, monkeypatch):
    x = np.vstack([np.random.default_rng(5).normal(size=(300, 4)) * 0.1, [[90.0, 0, 0, 0], [90.2, 0, 0, 0]]])
    seen, whole = [], balls.components
    monkeypatch.setattr(balls, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    got = balls.chains(points(spark, x), np.full((1, 4), 30.0), 2.0).collect()  # no row is near its pivot: all are nodes of their own
    assert {(r.sample, r.first) for r in got} == {(f"c{i:05d}", "c00000" if i < 300 else "c00300") for i in range(302)}
    assert seen[0] < len(x)


def test_reach_bounds_what_a_task_holds(spark):
    def sizes(batch, d):
        yield pa.RecordBatch.from_arrays([pa.array([d.size]), pa.array([len(d)])], ["size", "rows"])

    got = balls.reach(points(spark, np.ones((3000, 2))), np.zeros((4000, 2)), sizes, "size long, rows long").toPandas()
    assert got["rows"].sum() == 3000 and got["size"].max() <= balls.PAIRS


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30], "a string, b string")
    got = {r.node: r.label for r in balls.components(edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(1, 31)} == {"n000"} and {got[f"n{i:03d}"] for i in range(32, 61)} == {"n031"}


def test_mixture_finds_the_groups(spark):
    r = np.random.default_rng(4)
    truth = r.integers(0, 4, 600)
    x = np.eye(4)[truth] @ (r.normal(size=(4, 8)) * 12) + r.normal(size=(600, 8))
    labels = [None if i % 9 == 0 else "abcd"[k] for i, k in enumerate(truth)]
    p = points(spark, x, labels=labels)
    reduce, best = mixture.fit(p, (2, 4, 8))
    assert len(best.weight) == 4 and np.isclose(best.weight.sum(), 1)
    got = mixture.clusters(p).collect()
    assert sum(g["size"] for g in got) == 600 and {g.annotation for g in got} >= set("abcd")
    assert all(1 <= len(g.typical) <= 3 for g in got)


def test_mixture_grows_with_the_kinds_and_converges(spark):
    r = np.random.default_rng(8)
    truth = np.repeat(np.arange(160), 10)
    x = (r.normal(size=(160, 8)) * 12)[truth] + r.normal(size=(1600, 8)) * 0.3
    p = points(spark, x)
    reduce, best = mixture.fit(p)
    assert len(best.weight) > 128
    (after,), (ll,), n = mixture._em(p, reduce, [best], x.var(0)[: best.mean.shape[1]])
    assert n == 1600 and mixture._em(p, reduce, [after], x.var(0)[: best.mean.shape[1]])[1][0] - ll < 1e-2 * n
    got = mixture.clusters(p, 10).select("size", "typical").collect()
    assert all(len({truth[int(s[1:])] for s in g.typical}) == 1 for g in got if g.size <= 10)


def test_reduction_holds_the_share(spark):
    x = np.random.default_rng(9).normal(size=(400, 40))
    axes = mixture.reduction(points(spark, x)).axes
    z = ((x - x.mean(0)) @ axes).var(0)
    assert axes.shape[1] > 24 and z.sum() >= 0.9 * 40


def test_clusters_of_nothing_and_of_copies(spark):
    assert mixture.clusters(points(spark, np.zeros((0, 3)))).count() == 0
    assert mixture.linked(points(spark, np.zeros((0, 3))), 1.0).count() == 0
    one = mixture.clusters(points(spark, np.ones((20, 3)))).collect()
    assert sum(g["size"] for g in one) == 20 and all(g.annotation is None for g in one)
    assert {r.first for r in mixture.linked(points(spark, np.ones((20, 3))), 1.0).collect()} == {"c00000"}


# --- problem 5 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [6, 7])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(similar, "LIST_ROWS", 25)
    r = np.random.default_rng(d)
    x = cloud(d, 240, d)
    x = np.vstack([x, x[20:40] * 3.5 + r.normal(size=(20, d)) * 0.01, np.zeros((3, d))])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for cosine in (0.9, 0.997):
        i, j = np.nonzero(u @ u.T >= cosine)
        want = {(f"c{a:05d}", f"c{b:05d}") for a, b in zip(i, j, strict=True) if a < b}
        got = [(q.sample_a, q.sample_b) for q in similar.similar_pairs(points(spark, x), cosine).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIST_ROWS", 60)
    r = np.random.default_rng(0)
    x = np.repeat(r.normal(size=(12, 16)) * 3, 50, 0) + r.normal(size=(600, 16))
    x *= r.lognormal(size=(600, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    true = {f"c{i:05d}": {f"c{j:05d}" for j in np.argsort(-c[i])[:5]} for i in range(600)}
    got = similar.nearest(points(spark, x), 5, probes=4).toPandas()
    assert len(got) == 3000 and (got["sample"] != got["other"]).all()
    assert np.mean([b in true[a] for a, b in zip(got["sample"], got["other"], strict=True)]) >= 0.9


@pytest.mark.parametrize("d", [10, 13])
def test_the_code_error_bound_holds(d):
    r = np.random.default_rng(1)
    x = similar.unit(r.normal(size=(300, d)))
    index = similar.Index(x, 5)
    codes, base, parallel, error = index.encode(x)
    left = np.stack([index.books[m][codes[:, m]] for m in range(len(index.books))], 1).reshape(len(x), -1)[:, :d]
    decoded = index.fine[base] + left
    q = similar.unit(x + r.normal(size=x.shape) * 0.1)
    assert np.allclose(((x - decoded) * x).sum(1), parallel, atol=1e-6)
    assert (np.abs((q * x).sum(1) - (q * decoded).sum(1) - parallel) <= np.linalg.norm(q - x, axis=1) * error + 1e-6).all()
    packed = similar._bytes(similar._packed(codes))  # noqa: SLF001
    assert codes.max() < 16 and packed.shape[1] == (codes.shape[1] + 1) // 2
    tables = index.tables(q)
    steps = np.concatenate([s for _, s in tables.scan(packed, base)])
    gap = decoded @ q.T - (tables.zero + tables.step * steps)
    assert steps.shape == (300, 300) and gap.min() > -1e-9 and gap.max() <= tables.slack < 0.005


def test_lists_on_several_levels(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAVES", 4)
    monkeypatch.setattr(similar, "LIST_ROWS", 20)
    x = cloud(11, 640, 6)
    u = similar.unit(x)
    index = similar.build(points(spark, x))
    assert [len(c) for c in index.levels] == [4, 4, 2]
    leaf = index.leaf(u)
    assert len(np.unique(leaf)) > 8
    for cosine in (0.9, 0.997):
        i, j = index.holding(u, cosine)
        asked = set(zip(i.tolist(), j.tolist(), strict=True))
        a, b = np.nonzero(u @ u.T >= cosine)
        assert all((p, leaf[q]) in asked for p, q in zip(a.tolist(), b.tolist(), strict=True)) and len(asked) < 32 * len(u)
        want = {(f"c{p:05d}", f"c{q:05d}") for p, q in zip(a, b, strict=True) if p < q}
        assert {(q.sample_a, q.sample_b) for q in similar.similar_pairs(points(spark, x), cosine).collect()} == want
    i, j = index.nearby(u, 3)
    assert (np.bincount(i) == 3).all() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
    assert np.mean([leaf[p] in set(j[i == p]) for p in range(len(u))]) > 0.9


def test_probes_follow_the_recall(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIST_ROWS", 25)
    p = points(spark, np.random.default_rng(2).normal(size=(500, 12)))
    index = similar.build(p)
    own = similar.members(p, index)
    few, many = (similar.probes_for(own, index, 5, share) for share in (0.3, 0.99))
    assert 1 <= few < many <= 32
    got, x = similar.nearest(p, 5).toPandas(), None
    x = {r.sample: similar.unit(np.array([r.vec]))[0] for r in p.collect()}
    names = sorted(x)
    u = np.array([x[n] for n in names])
    c = u @ u.T
    np.fill_diagonal(c, -9)
    true = {n: {names[j] for j in np.argsort(-c[i])[:5]} for i, n in enumerate(names)}
    assert np.mean([b in true[a] for a, b in zip(got["sample"], got["other"], strict=True)]) >= 0.9


def test_copies_stay_classes(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)  # copies of one vector meet in several blocks
    x = np.vstack([np.repeat([[1.0, 2.0, 3.0]], 30, 0), [[1.0, 2.0, 3.01]], [[-1.0, 0.0, 0.0]]])
    close, groups = similar.similar_classes(points(spark, x), 0.999)
    assert [(r.a, r.b) for r in close.collect()] == [("c00000", "c00030")]
    assert {r.rep for r in groups.collect()} == {"c00000", "c00030", "c00031"} and groups.count() == 32
    got = [(r.sample_a, r.sample_b) for r in similar.similar_pairs(points(spark, x), 0.999).collect()]
    assert len(got) == len(set(got)) == 31 * 30 // 2


def test_no_vectors_no_neighbours(spark):
    for x in (np.zeros((0, 4)), np.zeros((3, 4)), np.ones((1, 4))):
        assert similar.similar_pairs(points(spark, x), 0.9).count() == 0
        assert similar.nearest(points(spark, x), 3).count() == 0


# --- problem 6 -----------------------------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "\n\n", "plain words here", "it's we're I'll 'tis ''s 's", "1\r\n00:00:01,500 --> 00:00:02,000\r\nHi!\r\n\r\n", "﻿BOM \x00\x1c\x1d ctrl ​",
    "emoji 👩‍👩‍👧 ünïcödé ½² 漢字かな한국어", "<|endoftext|> <|startoftext|>", "x" * 700, "字" * 300, "a b" * 400, "\t   　end ", "tail spaces   ", "ﬀ ǆ ́x",
    "=-" * 400, "9" * 400, "  leading", "\r\r\n mixed\n\r ends", "a'b'c'd 'S 'RE",
]


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.vocabulary(vocabulary_path()), special_tokens={})


@tokenized
def test_encoding_and_round_trip(spark):
    enc = reference_encoding()
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids int").repartition(3)
    out = bytebpe.encode(docs, vocabulary_path())
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t, *_ in rows}
    back = out.withColumn("t", bytebpe.decode(out, vocabulary_path()).cast("string"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t, *_ in rows}
    counts = {r.doc_id: r.n_tokens for r in bytebpe.token_counts(docs, vocabulary_path()).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bytebpe.encode(docs.limit(0), vocabulary_path()).count() == 0
    assert [list(r.ids) for r in bytebpe.encode(docs.where("text is null"), vocabulary_path()).collect()] == [[], []]


@tokenized
def test_heap_and_fold_agree(spark):
    pairs, ranks = bytebpe.merges(vocabulary_path()), bytebpe.vocabulary(vocabulary_path())
    first = [ranks[bytes([i])] for i in range(256)]
    enc = reference_encoding()
    words = ["tokenization", " unbelievable", "ababababab", "字字字", "x" * 200, " ", "zq"]
    got = {r.word: list(r.ids) for r in bytebpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary_path()).collect()}
    assert got == {w: bytebpe.heap_ids(w.encode(), pairs, first) for w in words} == {w: enc.encode_ordinary(w) for w in words}


def test_words_are_those_of_the_pattern():
    import public_tokenizers
    import pyarrow as pa
    import regex

    r = np.random.default_rng(9)
    alphabet = list("ab1'  \n\r\t.,-srevlmtdSé字²  \x1ć")
    texts = ["".join(r.choice(alphabet, r.integers(0, 40))) for _ in range(3000)] + TEXTS
    flat, at = bytebpe.words_of(pa.array(texts))
    flat, rx = flat.to_pylist(), regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]] == rx.findall(t or "")


# --- problem 7 -----------------------------------------------------------------------------------------------------------


def test_plans_place_everything_once():
    r = np.random.default_rng(0)
    for capacity, n in ((10, 50), (64, 3000), (4096, 5000)):
        sizes = np.clip(r.lognormal(np.log(capacity) - 2, 1.0, n).astype(int), 1, capacity)
        counts = np.bincount(sizes, minlength=capacity + 1)
        made, used, placed = packing.plan(counts, capacity), 0, np.zeros(capacity + 1, int)
        for pattern, times in made:
            assert times > 0 and sum(pattern) <= capacity
            used += times
            np.add.at(placed, pattern, times)
        assert (placed == counts).all()
        assert used <= -(-sizes.sum() // capacity) * 1.02 + 1
    assert packing.plan(np.zeros(9, int), 8) == []


@pytest.mark.parametrize("ranked", [packing.RANKED, 7])
def test_packing(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    r = np.random.default_rng(1)
    sizes = [0, None, 100, 101, 250, *r.integers(1, 60, 300).tolist(), *[7] * 150]
    df = spark.createDataFrame([(i // 2, s, "x") for i, s in enumerate(sizes)], "n long, n_tokens int, container string")
    got = packing.pack(df.select(F.col("n"), "n_tokens", "container"), 100, key="n").toPandas()
    assert got.groupby("container")["n_tokens"].sum().max() <= 100
    total = sum(s or 0 for s in sizes)
    assert got["n_tokens"].sum() == total and got["container"].max() + 1 == got["container"].nunique() <= -(-total // 100) + 1
    assert len(got) == len(sizes) + 1 + 2 and (got.loc[got["pieces"] > 1].groupby("n")["n_tokens"].sum() > 100).all()
    row = packing.fill(packing.pack(df, 100, key="n"), 100).first()
    assert row.tokens == total and row.filled > 0.95
    assert packing.pack(df.limit(0), 100, key="n").count() == 0
    assert packing.fill(packing.pack(df.limit(0), 100, key="n"), 100).first().containers == 0
    assert [x.container for x in packing.pack(df.limit(1), 100, key="n").collect()] == [0]


def test_triples_are_found_beyond_the_largest_first_sizes():
    half = np.array([1500 + int(f"{i:b}", 3) for i in range(80)])  # no one is the mean of two others
    counts = np.zeros(10001, int)
    counts[half] = counts[10000 - 2 * half] = 1  # the largest first sizes pass the pair test by a size that is there once
    assert packing._Stock(counts).triple(10000, []) is None
    counts[[4001, 3498, 2501]] = 1
    assert packing._Stock(counts).triple(10000, []) == [4001, 3498, 2501]


# --- problem 8 -----------------------------------------------------------------------------------------------------------


def long_texts():
    r = np.random.default_rng(3)
    words = ["alpha", "it's", "über", "字幕", "...", "42", "the", "and then", "Ω"]
    cue = lambda i, end: f"{i}{end}00:00:{i % 60:02d},100 --> 00:00:{i % 60:02d},900{end}{' '.join(r.choice(words, 12))}{end}{end}"
    texts = ["".join(cue(i, end) for i in range(1, 160)) for end in ("\n", "\r\n", "\r")]
    texts += ["".join(f"{{{i}}}{{{i + 9}}}{' '.join(r.choice(words, 9))}\n" for i in range(200)), " ".join(r.choice(words, 3000)), "\n".join(" ".join(r.choice(words, 8)) for _ in range(300))]
    texts += ["q7" * 3000, "漢" * 4000, "x" * 9000, "ab " + "y1" * 2000 + " cd " * 600, "\n" * 5000, "short", "", None, " " * 3000, "a" * 1025]
    return texts


def check_pieces(enc, texts, got, limit, overlap):
    """Cover, order, limits, repeats and numbers of all pieces."""
    assert set(got["doc_id"]) == {i for i, t in enumerate(texts) if t and len(enc.encode_ordinary(t)) > limit}
    for doc, x in got.groupby("doc_id"):
        text, end = texts[doc], 0
        assert x["piece"].tolist() == list(range(len(x))) and (x["pieces"] == len(x)).all()
        for row in x.itertuples():
            assert row.text == text[row.start : row.end] and row.start <= end < row.end
            assert len(enc.encode_ordinary(row.text)) <= min(limit, row.n_tokens)
            assert len(enc.encode_ordinary(text[row.start : end])) <= overlap
            end = row.end
        assert end == len(text)


@tokenized
def test_pieces(spark):
    enc, limit, overlap = reference_encoding(), 256, 32
    texts = long_texts()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, piece int, section string").repartition(4)
    got = splitting.split(docs, vocabulary_path(), limit, overlap).toPandas().sort_values(["doc_id", "piece"])
    check_pieces(enc, texts, got, limit, overlap)
    cues = got[got["doc_id"].isin([0, 1, 2, 3])]
    inner = cues[cues["piece"] < cues["pieces"] - 1]
    assert (inner["cut"] == splitting.CUE).all()
    assert all(texts[row.doc_id][row.end] in "{0123456789" for row in inner.itertuples())
    lines = got[(got["doc_id"] == 5) & (got["piece"] < got["pieces"] - 1)]
    assert all(t.endswith("\n") for t in lines["text"])
    spaced = got[(got["doc_id"] == 4) & (got["piece"] < got["pieces"] - 1)]
    assert (spaced["cut"] == splitting.WORD).all()


@tokenized
def test_pieces_of_sections(spark, monkeypatch):
    """Long texts in sections of the least size, 8,192 bytes; nothing shorter changes."""
    monkeypatch.setattr(splitting, "SECTION", 1)
    enc, limit, overlap, r = reference_encoding(), 32, 16, np.random.default_rng(4)
    texts = [t and t * 6 for t in long_texts()] + ["漢字かな" * 20000, "w" * 70000, "-" * 9000 + " x" * 9000, "'s" * 30000, "".join(r.choice(list("ab1'.,  \n\té字　"), 40000)), "a\n" * 9000, " \n  \n" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cut = splitting.sections(docs, limit, 8192, 4096).toPandas().sort_values(["doc_id", "section"])
    for doc, x in cut.groupby("doc_id"):
        assert "".join(t[b:] for t, b in zip(x["text"], x["before"], strict=True)) == texts[doc]
        assert x["text"].str.len().max() <= 8192 + 4096 + 2048
    assert cut["apart"].sum() > 50 and (cut.loc[cut["doc_id"].isin([0, 1, 2, 3]) & (cut["end_kind"] > 0), "end_kind"] == splitting.CUE).all()
    got = splitting.split(docs, vocabulary_path(), limit, overlap).toPandas().sort_values(["doc_id", "piece"])
    check_pieces(enc, texts, got, limit, overlap)
    monkeypatch.setattr(splitting, "SECTION", 1 << 20)
    whole = splitting.split(docs, vocabulary_path(), limit, overlap).toPandas()
    some = [i for i, t in enumerate(texts) if t and len(t.encode()) <= 8192]
    key = lambda d: sorted(map(tuple, d[d["doc_id"].isin(some)].itertuples(index=False)))
    assert key(got) == key(whole) and len(got) < 1.1 * len(whole)


@tokenized
def test_edges_do_not_depend_on_the_slice():
    r, halo = np.random.default_rng(5), 600
    for alphabet in ("ab1'.,  \n\r\té字　-", "1:2,0>- {}\n", "漢字", "a"):
        text = "".join(r.choice(list(alphabet), 3000)).encode()
        for at in range(1600, 2200, 7):
            want = splitting._edge(text, at, halo)  # noqa: SLF001
            again = splitting._edge(text[at - 1544 :], 1544, halo)  # noqa: SLF001
            assert (want[0], *want[1:]) == (again[0] + at - 1544, *again[1:])
            if want[1] or want[0] == len(text) or want[2]:
                assert want[0] >= at
            flat, starts = bytebpe.words_of(__import__("pyarrow").array([text.decode()]))
            begins = np.cumsum([0, *[len(w.encode()) for w in flat.to_pylist()]])
            assert want[2] or want[0] in begins


@tokenized
def test_long_texts_are_encoded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bytebpe, "BLOCK_BYTES", 2000)
    enc = reference_encoding()
    texts = [t and t * 2 for t in long_texts()] + TEXTS
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted((i // 2, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert sorted((r.doc_id, list(r.ids)) for r in bytebpe.encode(docs, vocabulary_path()).collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in bytebpe.token_counts(docs, vocabulary_path()).collect()) == [(i, len(x)) for i, x in sorted(want, key=lambda w: (w[0], len(w[1])))]


def test_no_long_texts_no_pieces(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None), (None, "x" * 5000)], "doc_id long, text string")
    if os.path.exists(vocabulary_path()):
        assert splitting.split(docs, vocabulary_path()).count() == 0
        assert splitting.split(docs.limit(0), vocabulary_path()).count() == 0


# --- the subpackage as a whole -------------------------------------------------------------------------------------------


def test_nothing_else_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "lumenact")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "llm" not in source.read(), f
