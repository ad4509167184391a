"""Edge cases of single operators against hand-made or brute-force results."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cellweave as cw
from cellweave.functions.hashing import take_by_hash
from cellweave.functions.numeric import decay_quota, erfc_sql
from cellweave.functions.orderstats import bh_adjust, exact_quantiles, midranks, position_in_group
from cellweave.functions.palette import cluster_colors
from cellweave.functions.text import extract_field, make_unique, strip_common_suffix
from cellweave.operators import (
    ballindex, cluster, correction, embed, graph, hvg, knn, linkage, markers, normalize, pca_genes, qc, sampling, vectors,
)
from cellweave.operators.vectors import dense_vectors
from cellweave.plans import figures
from tests.conftest import agreement, experiment


@pytest.fixture(scope="module", autouse=True)
def numpy_rows(spark):
    """These tests make their own inputs from lists of numpy rows, which only Arrow takes; other modules run without it."""
    key = "spark.sql.execution.arrow.pyspark.enabled"
    spark.conf.set(key, "true")
    yield
    spark.conf.unset(key)



def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_and_ranks_with_split_groups(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n) * 3, n % 2)
    x[: n // 3] = x[0]  # a third of the rows share one value
    pdf = pd.DataFrame({"x": x, "g": np.arange(n) % 2})
    df = spark.createDataFrame(pdf)
    probs = [0, 0.001, 0.1, 0.5, 0.77, 1]
    for small in (0, 10**6):
        assert np.allclose(exact_quantiles(df, "x", probs, small_rows=small).first()[0], np.quantile(x, probs))
        for r in exact_quantiles(df, "x", probs, ["g"], accuracy=50, small_rows=small).collect():
            assert np.allclose(r.q, np.quantile(x[pdf.g == r.g], probs))
    want = pdf.assign(rank=pdf.groupby("g").x.rank()).drop_duplicates()
    for split in (3, 10**6):
        got = midranks(df, ["g"], "x", split_rows=split).toPandas()
        both = want.merge(got, on=["g", "x"])
        assert len(both) == len(got) and (both["rank_x"] == both["rank_y"]).all()


def test_bh_matches_definition_with_nulls(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(200), 2)
    pdf = pd.DataFrame({"g": np.arange(200) % 2, "i": range(200), "p": p})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(F.col("i") != 7, F.col("p")))
    for split in (5, 10**6):
        got = bh_adjust(df, ["g"], "p", split_rows=split).toPandas().sort_values("p")
        assert len(got) == 200 and got.loc[got.i == 7, "qvalue"].isna().all()
        for _, part in got.dropna().groupby("g"):
            raw = part.p.to_numpy() * len(part) / np.arange(1, len(part) + 1)
            assert np.allclose(part.qvalue, np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1]))


def test_erfc(spark):
    df = spark.range(0, 5200).selectExpr("id / 200D AS x").withColumn("e", F.expr(erfc_sql("x"))).toPandas()
    assert np.allclose(df.e, df.x.map(math.erfc), rtol=1e-12, atol=0)


def test_position_in_group_across_blocks(spark):
    df = spark.range(100).withColumn("name", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 5)))
    got = position_in_group(df, ["name"], "id", width=7).toPandas().sort_values("id")
    assert (got.position == got.groupby("name").cumcount() + 1).all()


def test_hash_sampling_takes_exact_quotas(spark):
    df = spark.range(3000).select(F.col("id").alias("cell_idx"), F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 3 + 2).alias("g"))
    got = take_by_hash(df, "cell_idx", lambda n: F.floor(n / 4), ["g"], seed=5).groupBy("g").count().toPandas()
    sizes = df.groupBy("g").count().toPandas().set_index("g")["count"]
    assert all(r["count"] == sizes[r.g] // 4 for _, r in got.iterrows())
    assert take_by_hash(df, "cell_idx", 10).count() == 10
    assert take_by_hash(df.limit(1), "cell_idx", 10).count() == 1


def test_filters_are_strict_where_they_should_be(spark):
    counts = np.array([[3, 3, 2, 0], [3, 0, 3, 0], [2, 3, 3, 0], [3, 3, 3, 0], [0, 0, 0, 0]])
    exp = experiment(spark, counts)
    support = {r.cell_idx: r.n_genes for r in qc.cell_support(exp.expr, exp.cells, 3).collect()}
    assert support == {0: 2, 1: 2, 2: 2, 3: 3, 4: 0}
    kept = {r[0] for r in qc.good_cells(exp.expr, exp.cells, 3, 0.25, 1.0).select("cell_idx").collect()}
    assert kept == {0, 1, 2, 3}
    genes = {r.gene_idx: r.n_cells for r in qc.gene_support(exp.expr, exp.genes, 2).collect()}
    assert genes == {0: 3, 1: 3, 2: 3, 3: 0}
    assert qc.good_genes(exp.expr, exp.genes, 2, 2).count() == 3
    assert qc.good_genes(exp.expr, exp.genes, 2, 3).count() == 0


def test_normalised_totals_equal_the_median(spark):
    counts = np.random.default_rng(1).poisson(1.0, (9, 6))
    counts[3], counts[:, 2] = 0, 0
    exp = cw.normalize_counts(experiment(spark, counts), return_log=True)
    got = exp.expr.groupBy("cell_idx").agg(F.sum("norm").alias("t")).toPandas()
    assert np.allclose(got["t"], np.median(counts.sum(axis=1))) and 3 not in set(got["cell_idx"])
    assert "log" in exp.expr.columns


def r_bins(mean, disp):
    edges = np.quantile(mean, [p / 100 for p in range(10, 101, 5)])
    bins = 1 + (edges[None, :] < mean[:, None]).sum(axis=1)
    out = np.empty(len(mean))
    for b in np.unique(bins):
        d = disp[bins == b]
        med = np.median(d)
        out[bins == b] = np.abs(d - med) / (1.4826 * np.median(np.abs(d - med)))
    return bins, out


def test_dispersion_scores_match_dense_computation(spark):
    counts = np.random.default_rng(2).poisson(np.random.default_rng(3).gamma(2, 2, 120), (40, 120))
    exp = cw.rank_genes(cw.normalize_counts(experiment(spark, counts)), 10)
    norm = counts / (counts.sum(1) / np.median(counts.sum(1)))[:, None]
    mean, var = norm.mean(0), norm.var(0, ddof=1)
    _, score = r_bins(mean, var / mean)
    got = exp.genes.orderBy("gene_idx").toPandas()
    assert np.allclose(got["dispersion_norm"], score)
    cutoff = np.sort(score)[::-1][9]
    assert (got["hvg"].astype(bool) == (score >= cutoff - 1e-12)).all()


def test_variable_flag_keeps_ties_and_undefined(spark):
    scores = frame(spark, [(0, 3.0), (1, 2.0), (2, 2.0), (3, 1.0), (4, None), (5, float("inf"))], "gene_idx long, dispersion_norm double")
    flags = {r.gene_idx: r.hvg for r in hvg.flag_variable(scores, 3).collect()}
    assert flags == {0: True, 1: True, 2: True, 3: False, 4: None, 5: True}
    assert all(r.hvg in (True, None) for r in hvg.flag_variable(scores, 50).collect())
    two = scores.withColumn("batch", F.lit(1)).unionByName(scores.withColumn("batch", F.lit(2)))
    assert hvg.flag_variable(two, 1, ["batch"]).where("hvg").count() == 2


def test_bins_with_an_undefined_gene_are_undefined(spark):
    moments = frame(spark, [(i, float(i > 0) * i, None if i == 0 else 1.0 + i % 3) for i in range(40)], "gene_idx long, mean double, dispersion double")
    spread = {r.bin: r.bin_median for r in hvg.bin_spread(hvg.expression_bins(moments)).collect()}
    assert spread[1] is None and all(v is not None for b, v in spread.items() if b != 1)


def test_quota_rounds_half_to_even_and_fits(spark):
    assert frame(spark, [(5,)], "s long").select(decay_quota(F.col("s"), 0.5, 0.5, 500)).first()[0] == 2
    sizes = spark.range(1, 3000, 13).select(F.col("id").alias("s"), decay_quota(F.col("id"), 0.195, 0.9, 500).alias("q")).toPandas()
    assert (sizes.q <= sizes.s).all() and (sizes.q >= 0).all()
    single = frame(spark, [(42, 1)], "cell_idx long, part long")
    assert {r[0] for r in sampling.sps_sample(single).collect()} <= {42}


def test_cluster_zero_and_missing_are_not_sampled(spark):
    labels = frame(spark, [(i, [0, 1, 2, None][i % 4]) for i in range(40)], "cell_idx long, cluster_id int")
    got = sampling.stratified_sample(labels, 3).groupBy("cluster_id").count().toPandas()
    assert dict(zip(got.cluster_id, got["count"])) == {1: 3, 2: 3}
    assert sampling.stratified_sample(labels, None).count() == 20


def test_vote_ties_and_confidence_are_strict(spark):
    near = frame(spark, [(0, r, n, 0.1) for r, n in enumerate([10, 11, 12, 13])] + [(1, r, n, 0.1) for r, n in enumerate([10, 10, 12, 99])],
                 "cell_idx long, nn_rank int, nn_cell_idx long, dist double")
    labels = frame(spark, [(10, 2), (11, 2), (12, 1), (13, 1)], "cell_idx long, label int")
    low = {r.cell_idx: r for r in cluster.vote(near, labels, 0.4).collect()}
    assert (low[0].label, low[0].votes, low[0].assigned) == (1, 2, 1)  # tie goes to the smaller label
    assert (low[1].n_neighbours, low[1].assigned) == (4, 2)  # an unlabelled neighbour counts in the share
    assert all(r.assigned is None for r in cluster.vote(near, labels, 0.5).collect())  # equal is not enough


def test_relabel_drops_labels_no_sampled_cell_got(spark):
    votes = frame(spark, [(0, 5), (1, 9), (2, 7), (3, None)], "cell_idx long, assigned int")
    sampled = frame(spark, [(0,), (1,), (3,)], "cell_idx long")
    assert {r.cell_idx: r.cluster_id for r in cluster.relabel(votes, sampled).collect()} == {0: 1, 1: 2, 2: None, 3: None}


def vector_frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"cell_idx": range(len(x)), "vec": list(x)}), "cell_idx long, vec array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_match_brute_force_in_both_ways(spark, metric):
    x = np.random.default_rng(4).normal(size=(60, 5))
    x[7], x[8], x[9] = x[3], x[3], 0  # copies and a zero vector
    v = vector_frame(spark, x)
    sample = v.where("cell_idx < 33")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    dist = 1 - unit @ unit[:33].T if metric == "cosine" else np.sqrt(((x[:, None] - x[None, :33]) ** 2).sum(2))
    want = np.argsort(np.round(dist, 8), axis=1, kind="stable")[:, :4]
    for budget in (10**9, 8 * 5 * 8):
        got = knn.nearest(v, sample, 4, metric, budget).toPandas().sort_values(["cell_idx", "nn_rank"])
        assert (got.nn_cell_idx.to_numpy().reshape(60, 4) == want).all()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_index_is_exact_prunes_and_splits_hot_balls(spark, monkeypatch, metric):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 6)) * 10
    x = centers[rng.integers(0, 12, 900)] + rng.normal(scale=0.2, size=(900, 6))
    x[300:600] = x[0]  # a third of all vectors are equal
    x[700] = 0
    monkeypatch.setattr(ballindex, "PLANNED", 500)
    index = ballindex.build_index(vector_frame(spark, x).repartition(5), metric, page_rows=20, pivots=15)
    sizes = [r.n for r in index.leaves.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 20 and len(index.nodes.page) == len(sizes)
    asked = vector_frame(spark, x[::9])
    dist = np.round(ballindex.distances(ballindex.prepared(x[::9], metric), ballindex.prepared(x, metric), metric), 10)
    want = np.argsort(dist, axis=1, kind="stable")[:, :7]
    got = index.search(asked, 7).toPandas().sort_values(["cell_idx", "nn_rank"])
    assert (got.nn_cell_idx.to_numpy().reshape(100, 7) == want).all()
    assert np.allclose(got.dist.to_numpy().reshape(100, 7), np.take_along_axis(dist, want, axis=1))
    # far from all pages are compared
    bound, _ = index.nodes.bounds(ballindex.prepared(x[::9], metric))
    assert (bound <= np.take_along_axis(dist, want[:, -1:], axis=1)).mean() < 0.6
    near = index.search(asked, 7, pages=6).toPandas().sort_values(["cell_idx", "nn_rank"])
    assert near.groupby("cell_idx").size().eq(7).all()
    reach = near.groupby("cell_idx").dist.max().to_numpy()
    assert (reach <= np.take_along_axis(dist, want[:, -1:], axis=1)[:, 0] + 1e-9).mean() > 0.5
    with pytest.raises(ValueError):
        ballindex.build_index(asked.limit(0))


def test_edges_degrees_modularity(spark):
    near = frame(spark, [(0, 1), (1, 0), (1, 2), (2, 2), (3, 4)], "cell_idx long, nn_cell_idx long")
    edges = graph.graph_edges(near)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (1, 2), (3, 4)]
    labels = frame(spark, [(i, int(i > 2)) for i in range(5)], "node long, community long")
    assert graph.modularity(edges, labels).first().modularity == pytest.approx(1 - (16 + 4) / 36)


def test_louvain_finds_cliques(spark):
    edges = [(a + 6 * c, b + 6 * c) for c in range(4) for a, b in combinations(range(6), 2)] + [(0, 6), (6, 12), (12, 18)]
    found = graph.louvain(frame(spark, edges, "src long, dst long"), seed=2).toPandas()
    assert len(found) == 24 and found.groupby(found.node // 6).community.nunique().eq(1).all()
    assert found.community.nunique() == 4


def test_average_linkage_equals_sequential_merging(spark):
    x = np.random.default_rng(5).normal(size=(25, 4))
    full = linkage.angles(x)
    assert full[2, 7] == pytest.approx(math.acos(x[2] @ x[7] / np.linalg.norm(x[2]) / np.linalg.norm(x[7])) / math.pi)
    groups, merges = {i: [i] for i in range(25)}, []
    while len(groups) > 1:
        mean = lambda p: np.mean([full[i, j] for i in groups[p[0]] for j in groups[p[1]]])
        a, b = min(combinations(sorted(groups), 2), key=mean)
        merges.append((b, a, mean((a, b))))
        groups[a] += groups.pop(b)
    got = linkage.tree_merges(linkage.grow_tree(vector_frame(spark, x).repartition(4))).collect()
    assert [(r.child, r.parent) for r in sorted(got, key=lambda r: r.height)] == [m[:2] for m in merges]
    assert np.allclose(sorted(r.height for r in got), [m[2] for m in merges])


def planted_directions(sizes, spread, seed=1, dims=30):
    rng = np.random.default_rng(seed)
    centers = np.linalg.qr(rng.normal(size=(dims, len(sizes))))[0].T * 3
    label = np.repeat(np.arange(len(sizes)), sizes)
    return centers[label] + rng.normal(scale=spread, size=(len(label), dims)), label


def test_adaptive_cut_finds_branches_of_unequal_height():
    x, label = planted_directions([60, 40, 30, 5], 0.15)
    x[:60:2] += np.random.default_rng(3).normal(scale=0.0, size=(30, 30)) + np.eye(30)[5] * 1.5  # two halves close to each other
    d = linkage.angles(x)
    merges = linkage.chain_merges(d)
    found = linkage.adaptive_cut(d, merges, deep_split=2)
    assert agreement(label[label < 3], linkage.adaptive_cut(d, merges)[label < 3]) == 1  # less deep: the halves stay together
    # a single height either joins the halves or leaves the five cells alone; branches tell four groups
    halves = np.where(label == 0, 10 + np.arange(len(label)) % 2, label)
    assert agreement(halves[label < 3], found[label < 3]) == 1 and set(found[label < 3]) == {1, 2, 3, 4}
    assert [(found == c).sum() for c in (1, 2)] == sorted([(found == c).sum() for c in (1, 2)], reverse=True)
    # deeper splitting never finds fewer clusters; a huge least size finds none
    counts = [linkage.adaptive_cut(d, merges, deep_split=k).max() for k in range(5)]
    assert counts == sorted(counts) and linkage.adaptive_cut(d, merges, least=500).max() == 0
    assert linkage.core_scatter([0, 1, 2], d, 20) == pytest.approx((d[0, 1] + d[0, 2] + d[1, 2]) / 3)
    assert len(linkage.adaptive_cut(np.zeros((1, 1)), [])) == 1


def test_cells_beyond_the_fit_follow_it(spark):
    x, label = planted_directions([80, 60, 50], 0.2)
    found = linkage.hierarchical_labels(vector_frame(spark, x), fit_cells=120).toPandas().sort_values("cell_idx")
    assert len(found) == 190 and agreement(label, found.label.to_numpy()) == 1
    assert [int((found.label == c).sum()) for c in (1, 2, 3)] == [80, 60, 50]


def dense_tests(norm, labels):
    rows = []
    for c in sorted(set(labels)):
        a = labels == c
        for g in range(norm.shape[1]):
            v = norm[:, g]
            if not v.any():
                continue
            r = pd.Series(v).rank().to_numpy()
            n_a, n_b = a.sum(), (~a).sum()
            u = r[a].sum() - n_a * (n_a + 1) / 2
            t = pd.Series(v).value_counts().to_numpy(float)
            n = n_a + n_b
            sigma = math.sqrt(n_a * n_b / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
            away = u - n_a * n_b / 2
            z = (away - 0.5 * np.sign(away)) / sigma if sigma else np.nan
            rows.append((g, c, u, z, math.erfc(abs(z) / math.sqrt(2)), v[a].mean(), v[~a].mean()))
    return pd.DataFrame(rows, columns=["gene_idx", "cluster_id", "u", "z", "pvalue", "mean_a", "mean_b"])


def test_sparse_rank_tests_match_dense(spark):
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.7, (130, 12)).astype(float)
    counts[:, 5] = 0
    counts[:, 6] = np.where(np.arange(130) % 3 == 0, 2.0, 0.0)  # only one cluster has it
    labels = np.arange(130) % 3 + 1
    exp = experiment(spark, counts)
    expr = exp.expr.withColumn("norm", F.col("count"))
    held = spark.createDataFrame(pd.DataFrame({"cell_idx": range(130), "cluster_id": labels}), "cell_idx long, cluster_id int")
    for split in (2, 10**6):
        got = markers.test_markers(expr, held, split_rows=split).toPandas()
        want = dense_tests(counts, labels).merge(got, on=["gene_idx", "cluster_id"], suffixes=("", "_got"))
        assert len(want) == len(got) == 33
        for c in ("u", "z", "pvalue", "mean_a", "mean_b"):
            assert np.allclose(want[c], want[f"{c}_got"], atol=1e-12), c
    only = got[got.gene_idx == 6].set_index("cluster_id").lfc
    assert only[1] == np.inf and only[2] == -np.inf


def test_exact_small_sample_test(spark):
    from itertools import permutations

    assert markers._rank_sum_cdf(2, 3)[0] == pytest.approx(1 / 10)
    values = np.arange(1.0, 8.0)
    picks = list(combinations(range(7), 3))
    us = [sum(p) + 3 - 6 for p in picks]
    cdf = markers._rank_sum_cdf(3, 4)
    for u in range(13):
        assert cdf[u] == pytest.approx(np.mean([x <= u for x in us]))
    exp = experiment(spark, values[:, None])
    held = frame(spark, [(i, 1 if i >= 4 else 2) for i in range(7)], "cell_idx long, cluster_id int")
    got = markers.test_markers(exp.expr.withColumn("norm", F.col("count")), held).collect()
    assert all(r.pvalue == pytest.approx(2 / 35) for r in got)


def test_marker_order_prefers_small_changes_on_ties(spark):
    found = frame(spark, [(1, 0, 0.01, 3.0, "a"), (1, 1, 0.01, 2.0, "b"), (1, 2, 0.001, 9.0, "c"), (2, 3, 0.5, 1.0, "d")],
                  "cluster_id int, gene_idx long, qvalue double, lfc double, symbol string")
    wide = markers.markers_wide(markers.top_markers(found, 2), [1, 2]).collect()
    assert [(r.cluster_1, r.cluster_2) for r in wide] == [("c", "d"), ("b", "")]


def brute_thinning(x, close_th, cells_th, limit):
    n, p = x.shape
    pairs = set()
    for row in x:
        order = sorted(range(p), key=lambda j: (row[j], j))
        pairs |= {(min(a, b), max(a, b)) for a, b in zip(order, order[1:])}
    gone = set()
    for a, b in sorted(pairs):
        if a in gone or b in gone:
            continue
        lo, hi = np.minimum(x[:, a], x[:, b]), np.maximum(x[:, a], x[:, b])
        ok = lo >= 0.001
        if ((hi[ok] - lo[ok]) / lo[ok] < close_th).sum() > cells_th * n:
            gone.add(a)
        if len(gone) >= limit:
            break
    return gone, pairs


@pytest.mark.parametrize("seed", range(4))
def test_thinning_matches_the_sequential_walk(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.poisson(1.2, (14, 9)).astype(float)
    x[seed] = 0
    if seed == 1:
        x[:, 8] += 1
    exp = experiment(spark, x)
    values = exp.expr.withColumnRenamed("count", "value")
    gone, pairs = brute_thinning(x, 0.6, 0.15, 1000)
    adjacent = correction.adjacent_pairs(values.withColumnRenamed("gene_idx", "pos"), 14, 9)
    assert {(r.g1, r.g2) for r in adjacent.collect()} == pairs
    kept = {r[0] for r in correction.reduce_genes(values, exp.cells, exp.genes, 0.6, 0.15).select("gene_idx").collect()}
    assert kept == set(range(9)) - gone
    close = correction.close_gene_pairs(values, exp.cells, exp.genes, 0.6, 0.15)
    assert {r[0] for r in correction.removable_genes(close, 2).collect()} == brute_thinning(x, 0.6, 0.15, 2)[0]


def test_rank_transform_keeps_zeros_absent(spark):
    x = np.array([[5.0, 5.0, 0.0, 1.0], [0, 0, 0, 0], [2, 3, 3, 3]])
    got = correction.rank_transform(experiment(spark, x).expr, "count").toPandas().pivot(index="cell_idx", columns="gene_idx", values="rank").fillna(0)
    assert got.to_numpy().tolist() == [[2.5, 2.5, 0, 1], [1, 3, 3, 3]]


def test_components_match_numpy(spark):
    x = np.random.default_rng(7).normal(size=(50, 6)) * [5, 4, 3, 2, 1, 0.5]
    scores, axes, shares = pca_genes.principal_components(vector_frame(spark, x), 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(axes), np.abs(vectors[:, ::-1][:, :3]), atol=1e-8)
    assert np.allclose(shares, values[::-1][:3] / values.sum())
    got = np.stack(scores.orderBy("cell_idx").toPandas()["vec"])
    assert np.allclose(got, (x - x.mean(0)) @ axes)


@pytest.mark.parametrize("n, width, k", [(300, 400, 5), (30, 30_000, 4), (200, 12, 12), (6, 40, 5)])
def test_sketched_components_match_a_full_decomposition(spark, monkeypatch, n, width, k):
    """No genes x genes matrix: more genes than directions, 30,000 genes, few genes, fewer cells than components."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8)) * 2.0 ** np.arange(8)[::-1] @ rng.normal(size=(8, width)) + rng.normal(size=(n, width)) + 5
    monkeypatch.setattr(pca_genes, "MERGED_ROWS", 2)  # factors meet in several steps of the tree
    frame_x = spark.createDataFrame(list(zip(range(n), x.tolist())), "cell_idx long, vec array<double>").repartition(7)
    scores, axes, shares = pca_genes.principal_components(frame_x, k)
    centred = x - x.mean(axis=0)
    _, sizes, turned = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(shares, (sizes**2 / (sizes**2).sum())[:k], rtol=1e-6)
    assert np.allclose(np.abs((turned[:k] * axes.T).sum(axis=1)), 1, atol=1e-5)
    got = np.stack(scores.toPandas().sort_values("cell_idx")["vec"])
    assert np.allclose(got, centred @ axes, atol=1e-8)


def test_two_humps_beat_one(spark):
    rng = np.random.default_rng(8)
    one, two = rng.normal(size=400), np.concatenate([rng.normal(-6, 1, 200), rng.normal(6, 1, 200)])
    got = {r.pc: r.modality for r in pca_genes.component_modality(vector_frame(spark, np.stack([one, two], axis=1))).collect()}
    assert got[1] >= 2 and got[0] < got[1]


def test_spline_slopes_solve_the_penalised_problem():
    """Against the dense normal equations of the natural spline, and a straight line stays one."""
    y = np.random.default_rng(3).normal(size=60).cumsum()
    n, penalty = len(y), pca_genes.PENALTY
    q = np.zeros((n, n - 2))
    r = np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        q[i : i + 3, i] = 1, -2, 1
        r[i, i] = 2 / 3
        if i + 1 < n - 2:
            r[i, i + 1] = r[i + 1, i] = 1 / 6
    fit = np.linalg.solve(np.eye(n) + penalty * q @ np.linalg.inv(r) @ q.T, y)
    curve = np.concatenate([[0], np.linalg.solve(r, q.T @ fit), [0]])
    want = np.append(np.diff(fit) - (2 * curve[:-1] + curve[1:]) / 6, np.diff(fit)[-1] + (curve[-2] + 2 * curve[-1]) / 6)
    assert np.allclose(pca_genes.spline_slopes(y), want)
    assert np.allclose(pca_genes.spline_slopes(2.5 * np.arange(9.0)), 2.5)


def test_runs_count_humps():
    x = np.linspace(-10, 10, pca_genes.GRID)
    hump = lambda *centers: sum(np.exp(-0.5 * (x - c) ** 2) for c in centers)
    assert [pca_genes.half_runs(hump(*c)) for c in ((0,), (-4, 4), (-6, 0, 6))] == [1.0, 2.0, 3.0]
    assert pca_genes.half_runs(x) == 0.5
    # teeth that the spline levels do not count
    assert pca_genes.half_runs(hump(-4, 4) + 1e-4 * (-1) ** np.arange(len(x))) < pca_genes.GRID / 8


def test_density_of_binned_scores(spark):
    x = np.random.default_rng(2).normal(size=300)
    rows = pca_genes.density_bins(pca_genes.long_scores(vector_frame(spark, np.stack([x, np.ones(300)], axis=1)))).toPandas()
    assert set(rows.pc) == {0} and rows.weight.sum() == pytest.approx(1)
    bw, low, high = rows.bw[0], rows.low[0], rows.high[0]
    assert bw == pytest.approx(0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * 300**-0.2)
    weights = np.zeros(pca_genes.GRID)
    weights[rows.bin] = rows.weight
    at = np.linspace(low, high, pca_genes.GRID)
    exact = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).mean(axis=1) / (bw * np.sqrt(2 * np.pi))
    assert np.abs(pca_genes.density_on_grid(weights, bw, low, high) - exact).max() < 2e-3


def test_projection_uses_same_cluster_neighbours(spark):
    near = frame(spark, [(0, 10), (0, 11), (0, 12), (1, 10), (2, 12)], "cell_idx long, nn_cell_idx long")
    clusters = frame(spark, [(0, 1), (1, None), (2, 0), (10, 1), (11, 1), (12, 0)], "cell_idx long, cluster_id int")
    layout = frame(spark, [(10, [0.0, 2.0]), (11, [4.0, 4.0]), (12, [9.0, 9.0])], "cell_idx long, vec array<double>")
    assert {r.cell_idx: r.vec for r in embed.project(near, clusters, layout).collect()} == {0: [2.0, 3.0]}


def test_mutual_neighbours_remove_a_shift(spark):
    rng = np.random.default_rng(9)
    base = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + [20, 0, 0]])
    x = np.concatenate([base, base + rng.normal(scale=0.1, size=base.shape) + [0, 3, 0]])
    batches = spark.range(160).select(F.col("id").alias("cell_idx"), (F.col("id") >= 80).cast("int").alias("batch"))
    got = np.stack(correction.mutual_neighbour_correction(vector_frame(spark, x), batches, [0, 1], k=10).orderBy("cell_idx").toPandas()["vec"])
    assert np.abs((got[80:] - got[:80]).mean(axis=0)).max() < 1.0
    assert np.allclose(got[:80, 0], x[:80, 0], atol=1.0)  # only the direction of the shift is flattened


def test_reconstruction_is_the_low_rank_product(spark):
    corrected = vector_frame(spark, np.array([[1.0, 2.0], [0.0, 1.0]]))
    loadings = frame(spark, [(5, [1.0, 0.5]), (6, [0.0, 2.0])], "gene_idx long, weights array<double>")
    got = {(r.cell_idx, r.gene_idx): r.value for r in correction.reconstruct(corrected, loadings).collect()}
    assert got == {(0, 5): 2.0, (0, 6): 4.0, (1, 5): 0.5, (1, 6): 2.0}


def test_names(spark):
    names = ["a", "b", "a", "a.1", "a", "b", "a.3", "a"]
    df = spark.createDataFrame(pd.DataFrame({"i": range(8), "n": names}))
    got = [r.unique_name for r in make_unique(df, "n", "i").orderBy("i").collect()]
    assert got == ["a", "b", "a.2", "a.1", "a.4", "b.1", "a.3", "a.5"]
    text = frame(spark, [("x_y_z",), ("x_",), ("x",)], "s string")
    assert [r[0] for r in text.select(extract_field("s", 2)).collect()] == ["y", None, None]
    assert text.select(extract_field("s", "1,3")).first()[0] == "x_z"
    every = frame(spark, [("AA-1",), ("CC-1",)], "b string")
    assert [r[0] for r in strip_common_suffix(every, "b").collect()] == ["AA", "CC"]
    mixed = frame(spark, [("AA-1",), ("CC-2",)], "b string")
    assert [r[0] for r in strip_common_suffix(mixed, "b").collect()] == ["AA-1", "CC-2"]


def test_figure_numbers(spark):
    labels = frame(spark, [(i, c) for i, c in enumerate([1, 1, 1, 2, 2, 3])], "cell_idx long, cluster_id int")
    assert [(r.upto, r.pos) for r in figures.label_positions(labels).orderBy("cluster_id").collect()] == [(3, 2), (5, 4), (6, 6)]
    assert len(cluster_colors(4)) == 4 and cluster_colors(13)[1] == "#FF0000" and len(cluster_colors(30)) == 30
    a, b = embed.curve_parameters(0.1)
    assert a == pytest.approx(1.577, rel=0.02) and b == pytest.approx(0.895, rel=0.02)
    with pytest.raises(ValueError):
        dense_vectors(None, None, spark.range(vectors.MAX_GENES + 1).withColumnRenamed("id", "gene_idx"), None)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_search_in_slices_and_shares(spark, monkeypatch, metric):
    """Queries that are not done after a first visit: held in several slices, pages in several shares, with copies and ties."""
    monkeypatch.setattr(ballindex, "HELD_BYTES", 20_000)
    monkeypatch.setattr(ballindex, "TASK_PAIRS", 1_000)
    monkeypatch.setattr(ballindex, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)).round(1)
    x[50:90] = x[50]
    index = ballindex.build_index(vector_frame(spark, x).repartition(3), metric, page_rows=16)
    found = index.search(vector_frame(spark, x), 7)
    rows = found.toPandas().sort_values(["cell_idx", "nn_rank"])
    dist = ballindex.distances(ballindex.prepared(x, metric), ballindex.prepared(x, metric), metric)
    want = np.lexsort((np.broadcast_to(np.arange(400), dist.shape), dist), axis=-1)[:, :7]
    assert (rows.nn_cell_idx.to_numpy().reshape(400, 7) == want).all()
    assert np.allclose(rows.dist.to_numpy().reshape(400, 7), np.take_along_axis(dist, want, axis=1))


def test_growing_tables_are_not_sent_through_the_driver(spark, monkeypatch):
    """The joins of a search, of the rounds of Louvain and of a layout have no broadcast side but bounded ones."""
    from cellweave.operators import layout

    plans, write, with_totals = [], graph.materialize, graph.materialize_with

    def shown(df, name="stage", *args):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, *args)

    def shown_with(df, name, **totals):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return with_totals(df, name, **totals)

    for module in (ballindex, graph, layout):
        monkeypatch.setattr(module, "materialize", shown)
        monkeypatch.setattr(module, "materialize_with", shown_with)
    x = np.random.default_rng(2).normal(size=(300, 6))
    index = ballindex.build_index(vector_frame(spark, x), "euclidean", page_rows=16)
    near = index.search(vector_frame(spark, x), 5)
    edges = write(graph.graph_edges(near), "edges")
    graph.louvain(edges, 1).count()
    embed.fit_umap(vector_frame(spark, x), n_neighbors=5, n_epochs=10, block_size=100).count()
    embed.fit_tsne(vector_frame(spark, x), max_iter=20, block_size=100).count()
    sent = [(name, plan) for name, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoop" in plan]
    # a row for each partition of the numbered cells
    assert {name for name, _ in sent} <= {"numbers", "links", "block-links"}, sent[0]
    assert all(plan.count("BroadcastHashJoin") <= 2 for name, plan in sent)
    assert {"state", "visits", "finished", "layout", "field"} <= {name for name, _ in plans}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_streamed_pages_measure_few_pairs_in_full(monkeypatch, metric):
    """Products in single precision leave few pairs to measure, and lose no neighbour: copies, near copies, zeros, great lengths."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 24))
    x[100:300], x[300:400], x[400:450] = x[0], x[1] + rng.normal(size=(100, 24)) * 1e-7, 0.0
    x[500:520] *= 1e4
    x = ballindex.prepared(x, metric)
    k, size, asked = 9, 250, np.arange(0, 3000, 5)
    starts = np.arange(0, len(x), size)
    nodes = ballindex.Nodes(x[:1], np.arange(len(starts)), np.zeros(len(starts), int), np.zeros(len(starts)), np.full(len(starts), 1e9), metric)
    dist = ballindex.distances(x[asked], x, metric)
    limit = np.sort(dist[:, :size], axis=1)[:, k - 1]
    lists = lambda v, kind: pa.array([*v], pa.list_(kind))
    held = ballindex._Held(0, nodes, k)
    columns = [lists([[i] for i in asked], pa.int64()), lists([*x[asked]], pa.float64()), pa.array(limit), lists([[0]] * len(asked), pa.int32())]
    held.take(pa.RecordBatch.from_arrays(columns, ["ids", "vecs", "worst", "seen"]))
    measured, measure = [], ballindex._Held._measure
    monkeypatch.setattr(ballindex._Held, "_measure", lambda self, lo, row, *rest: (measured.append(len(row)), measure(self, lo, row, *rest)))
    monkeypatch.setattr(ballindex, "MEASURED", 700)
    for p, lo in enumerate(starts):
        columns = [pa.array([p]), lists([range(lo, lo + size)], pa.int64()), lists([x[lo : lo + size].ravel()], pa.float64())]
        held.visit(pa.RecordBatch.from_arrays(columns, ["page", "ids", "vecs"]))
    got = {i: [*zip(d, n)] for b in held.found() for i, n, d in zip(*(b.column(c).to_pylist() for c in ("cell_idx", "nn", "dist")))}
    assert sum(measured) < 0.15 * len(asked) * len(x)
    for row, i in enumerate(asked):
        others = sorted(zip(dist[row, size:], range(size, len(x))))[:k]
        expected = [(d, n) for d, n in others if d <= limit[row]]
        assert [n for _, n in got.get(i, [])] == [n for _, n in expected]
        assert np.allclose([d for d, _ in got.get(i, [])], [d for d, _ in expected], rtol=1e-9, atol=2e-10)
