"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cellweave.operators import hvg, markers, qc
from cellweave.plans import catalogue
from cellweave.sources import tables as T
from tests.compare import differences, run_sql

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
SLOW = {"louvain_modularity", "hclust_sizes", "umap_embed", "tsne_embed", "fastmnn_correct", "pca_variance", "pc_gene_topk", "kmeans_sizes"}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(queries()) and set(catalogue.QUERIES) - set(ORACLES) == SLOW


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(queries()[name](spark, FOLDER).toPandas(), run_sql(FOLDER, ORACLES[name])) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_FREE = [
    "count_matrix", "cell_totals", "filter_cells", "filter_genes", "count_normalize", "gene_mean_var", "gene_bins", "rank_genes_hvg",
    "presample", "sps_sample", "marker_pvalue", "bh_fdr", "merge_common_genes", "rank_transform", "scatter_label_centers", "make_unique_names",
]


@pytest.mark.parametrize("name", PYTHON_FREE)
def test_relational_queries_stay_in_the_jvm(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert not re.search(r"Python|InArrow|InPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(T.count_matrix(spark, FOLDER))
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    stored = catalogue.norm_matrix(spark, FOLDER, "supplier")
    text = plan(qc.gene_support(stored, T.genes(spark, FOLDER, "supplier"), 20))
    assert "GreaterThan(count,20.0)" in text and "ReadSchema: struct<gene_idx:bigint,count:double>" in text


def test_top_markers_are_limited_before_the_shuffle(spark):
    found = spark.range(100).selectExpr("id AS gene_idx", "id % 3 AS cluster_id", "0.5D AS qvalue", "1D AS lfc")
    assert "WindowGroupLimit" in plan(markers.top_markers(found, 5))


def test_moments_shuffle_partial_sums_only(spark):
    stored = catalogue.norm_matrix(spark, FOLDER, "supplier")
    text = plan(hvg.gene_moments(stored, T.genes(spark, FOLDER, "supplier"), T.cells(spark, FOLDER)))
    assert "partial_avg" in text
