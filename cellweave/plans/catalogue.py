"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.numeric import log2p1
from cellweave.functions.orderstats import bh_adjust
from cellweave.functions.text import extract_field, make_unique, strip_common_suffix, zero_padded
from cellweave.model import Experiment
from cellweave.operators import ballindex, cluster, correction, embed, graph, hvg, knn, linkage, markers, merge, normalize, pca_genes, qc, sampling
from cellweave.operators.vectors import dense_vectors
from cellweave.plans import figures
from cellweave.session import checkpoint_root, materialize
from cellweave.sources import delimited, tenx
from cellweave.sources import tables as T
from cellweave.sources.delimited import wide_to_long
from cellweave.streaming.assign import assign_stream

SEED = 7
SAMPLED_VECTORS = 250
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def rounded(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return (F.round(column, 6) + F.lit(0.0)).alias(alias or name)


def whole(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return column.cast("long").alias(alias or name)


def norm_matrix(spark: SparkSession, folder: str, gene: str) -> DataFrame:
    """The normalised matrix, written once per session as a shared stage."""
    build = lambda: normalize.normalized(T.stored_matrix(spark, folder, gene), T.cells(spark, folder))
    return T.once(spark, (folder, "norm", gene), build)


# ---- readers ----

def written_lines(lines: DataFrame, path: str, **options) -> None:
    """Files of ``line`` that hold, by rising name, the order of the other columns; no task sorts all lines."""
    order = [c for c in lines.columns if c != "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path, **options)


def written_10x(spark, folder) -> dict[str, str]:
    """Two version-3 directories made of the table: customers of even and odd key, suppliers of two types."""
    root = f"{checkpoint_root(spark)}/cellweave/10x-{uuid.uuid4().hex}"
    genes = T.genes(spark, folder, "supplier").select("gene_idx", "symbol")
    kind = F.when(F.col("gene_idx") % 2 == 0, "Gene Expression").otherwise("Antibody Capture")
    place = Window.partitionBy(F.lit(0)).orderBy("gene_idx")  # suppliers and customers of one directory are numbered as a file does
    features = materialize(genes.withColumn("row", F.row_number().over(place)), "features")
    paths = {}
    for name, rest in (("even", 0), ("odd", 1)):
        cells = T.cells(spark, folder).where(F.col("cell_idx") % 2 == rest).select("cell_idx", "cell_id")
        cells = materialize(cells.withColumn("column", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cell_idx"))), "barcodes")
        counts = T.stored_matrix(spark, folder, "supplier").join(cells, "cell_idx").join(features, "gene_idx")
        entries = counts.select(F.lit(2).alias("a"), F.col("column").alias("b"), F.col("row").alias("c"), F.concat_ws(" ", "row", "column", "count").alias("line"))
        sizes = f"{features.count()} {cells.count()} {entries.count()}"
        head = spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate real general"), (1, 0, 0, sizes)], "a int, b int, c int, line string")
        paths[name] = f"{root}/{name}"
        gz = {"compression": "gzip"}
        written_lines(head.union(entries), f"{paths[name]}/matrix.mtx.gz", **gz)
        written_lines(cells.select("column", F.concat("cell_id", F.lit("-1")).alias("line")), f"{paths[name]}/barcodes.tsv.gz", **gz)
        written_lines(features.select("row", F.concat_ws("\t", F.concat(F.lit("S"), "gene_idx"), "symbol", kind).alias("line")), f"{paths[name]}/features.tsv.gz", **gz)
    return paths


@query
def read_10x_types(spark, folder):
    found = tenx.read_10x_types(spark, written_10x(spark, folder))
    parts = [
        exp.expr.join(exp.cells, "cell_idx").join(exp.genes, "gene_idx").select(F.lit(kind).alias("feature_type"), "cell_id", "symbol", rounded("count"))
        for kind, exp in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def read_delimited(spark, folder):
    """A written file with a line per customer and a column per brand, brands as cells."""
    wide = T.stored_matrix(spark, folder, "brand").groupBy("cell_idx").pivot("gene_idx", list(range(1, 26))).sum("count")
    columns = [c for c in wide.columns if c != "cell_idx"]
    quoted = F.concat(F.lit('"customer, '), "cell_idx", F.lit('"'))
    lines = wide.select(F.col("cell_idx").alias("a"), F.concat_ws(",", quoted, *(F.coalesce(F.col(c), F.lit(0.0)) for c in columns)).alias("line"))
    head = spark.createDataFrame([(-1, ",".join(['""', *(f'"brand {c}"' for c in columns)]))], "a long, line string")
    path = f"{checkpoint_root(spark)}/cellweave/wide-{uuid.uuid4().hex}"
    written_lines(head.union(lines), path)
    exp = delimited.read_delimited(spark, path)
    return exp.expr.join(exp.cells, "cell_idx").join(exp.genes, "gene_idx").select("barcode", "symbol", rounded("count"))


# ---- quality, normalisation, gene ranking ----

@query
def count_matrix(spark, folder):
    return T.count_matrix(spark, folder).select("cell_idx", "gene_idx", rounded("count"))


@query
def cell_totals(spark, folder):
    totals = normalize.cell_totals(T.stored_matrix(spark, folder), T.cells(spark, folder))
    return totals.select("cell_idx", rounded("total"))


@query
def filter_cells(spark, folder):
    kept = qc.good_cells(T.stored_matrix(spark, folder), T.cells(spark, folder), min_count=10, ql_th=0.05, qh_th=0.95)
    return kept.select("cell_idx", whole("n_genes"))


@query
def filter_genes(spark, folder):
    kept = qc.good_genes(T.stored_matrix(spark, folder), T.genes(spark, folder), min_count=20, min_cell=18)
    return kept.select("gene_idx", whole("n_cells"))


@query
def count_normalize(spark, folder):
    expr = normalize.normalized(T.stored_matrix(spark, folder), T.cells(spark, folder))
    return expr.select("cell_idx", "gene_idx", rounded("norm"))


@query
def log2_normalize(spark, folder):
    expr = normalize.normalized(T.stored_matrix(spark, folder), T.cells(spark, folder))
    return expr.select("cell_idx", "gene_idx", rounded(log2p1("norm"), "logcount"))


def part_moments(spark, folder) -> DataFrame:
    moments = hvg.gene_moments(norm_matrix(spark, folder, "part"), T.genes(spark, folder), T.cells(spark, folder))
    return materialize(moments, "moments")


@query
def gene_mean_var(spark, folder):
    moments = hvg.gene_moments(norm_matrix(spark, folder, "part"), T.genes(spark, folder), T.cells(spark, folder))
    return moments.select("gene_idx", whole("nnz"), rounded("mean"), rounded("variance"))


@query
def gene_dispersion(spark, folder):
    moments = hvg.gene_moments(norm_matrix(spark, folder, "part"), T.genes(spark, folder), T.cells(spark, folder))
    return moments.select("gene_idx", rounded("dispersion"))


@query
def gene_bins(spark, folder):
    return hvg.expression_bins(part_moments(spark, folder)).select("gene_idx", whole("bin"))


@query
def bin_dispersion_stats(spark, folder):
    spread = hvg.bin_spread(materialize(hvg.expression_bins(part_moments(spark, folder)), "bins"))
    return spread.select(whole("bin"), whole("n_genes"), rounded("bin_median"), rounded("bin_mad"))


@query
def rank_genes_hvg(spark, folder):
    scores = materialize(hvg.dispersion_scores(part_moments(spark, folder)), "scores")
    return hvg.flag_variable(scores, 1000).select("gene_idx", whole("bin"), rounded("dispersion_norm"), "hvg")


# ---- sampling ----

@query
def presample(spark, folder):
    lines = T.table(spark, folder, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("cell_idx"))
    return sampling.presample(materialize(lines.distinct(), "lines"), SEED)


@query
def random_sample(spark, folder):
    return sampling.random_sample(T.cells(spark, folder).select("cell_idx"), 500, SEED)


@query
def stratified_sample(spark, folder):
    return sampling.stratified_sample(T.nation_labels(spark, folder), 40, SEED)


def segment_parts(spark, folder) -> DataFrame:
    return T.segment_labels(spark, folder).select("cell_idx", whole("cluster_id", "part"))


@query
def sps_quota(spark, folder):
    return sampling.sps_quota(segment_parts(spark, folder)).select("part", whole("size"), whole("quota"))


@query
def sps_sample(spark, folder):
    return sampling.sps_sample(segment_parts(spark, folder), seed=SEED)


@query
def sps_param_search(spark, folder):
    best = sampling.sps_param_search(segment_parts(spark, folder), 1000)
    return best.select(rounded("pinit"), rounded("pfin"), rounded("scale"), whole("total"), whole("miss"))


# ---- neighbours, graph, vote ----

def vectors(spark, folder) -> DataFrame:
    return T.vectors(spark, folder).select("cell_idx", "vec")


def vector_sample(spark, folder) -> DataFrame:
    return materialize(sampling.random_sample(vectors(spark, folder), SAMPLED_VECTORS, SEED), "sample")


def sampled_knn(spark, folder) -> tuple[DataFrame, DataFrame]:
    """``(knn, sample)``: every vector's 11 nearest among the sample."""
    sample = vector_sample(spark, folder)
    return materialize(knn.nearest(vectors(spark, folder), sample, 11), "knn"), sample


def vector_labels(spark, folder) -> DataFrame:
    return T.vectors(spark, folder).select("cell_idx", whole("label"))


def labels_of(spark, folder, sample: DataFrame) -> DataFrame:
    return vector_labels(spark, folder).join(sample.select("cell_idx"), "cell_idx", "left_semi")


def partition_edges(spark, folder) -> DataFrame:
    pool = materialize(vectors(spark, folder), "pool")
    return graph.graph_edges(knn.nearest(pool, pool, sampling.GRAPH_NEIGHBOURS))


@query
def knn_exact(spark, folder):
    found = knn.nearest(vectors(spark, folder), vector_sample(spark, folder), 11)
    return found.select("cell_idx", whole("nn_rank"), "nn_cell_idx", rounded("dist"))


@query
def knn_indexed(spark, folder):
    """Every vector whose id is divisible by 20 against all, through a written index of small pages."""
    every = vectors(spark, folder)
    index = ballindex.build_index(every, "cosine", page_rows=64)
    found = index.search(every.where("cell_idx % 20 = 0"), 11)
    return found.select("cell_idx", whole("nn_rank"), "nn_cell_idx", rounded("dist"))


@query
def knn_graph_edges(spark, folder):
    return partition_edges(spark, folder)


@query
def graph_degree(spark, folder):
    return graph.degrees(partition_edges(spark, folder)).select("node", whole("degree"))


@query
def modularity(spark, folder):
    labels = vector_labels(spark, folder).select(F.col("cell_idx").alias("node"), F.col("label").alias("community"))
    return graph.modularity(materialize(partition_edges(spark, folder), "edges"), labels).select(whole("n_edges"), rounded("modularity"))


def votes(spark, folder, conf: float) -> DataFrame:
    near, sample = sampled_knn(spark, folder)
    return cluster.vote(near, labels_of(spark, folder, sample), conf)


@query
def knn_vote(spark, folder):
    return votes(spark, folder, 0.1).select("cell_idx", whole("n_neighbours"), whole("label"), whole("votes"), whole("assigned"))


@query
def knn_vote_conf_sweep(spark, folder):
    confs = F.explode(F.array(*[F.lit(c) for c in (0.1, 0.2, 0.3, 0.4, 0.5, 0.75)]))
    swept = votes(spark, folder, 0.1).withColumn("conf", confs)
    above = F.col("votes") / F.col("n_neighbours") > F.col("conf")
    return swept.groupBy("conf").agg(whole(F.sum(above.cast("long")), "assigned"), whole(F.count(F.lit(1)), "cells"))


@query
def unassigned_count(spark, folder):
    missing = F.sum(F.col("assigned").isNull().cast("long"))
    return votes(spark, folder, 0.3).agg(whole(missing, "unassigned"), whole(F.count(F.lit(1)), "cells"))


@query
def relabel_clusters(spark, folder):
    near, sample = sampled_knn(spark, folder)
    held = materialize(cluster.vote(near, labels_of(spark, folder, sample), 0.3), "votes")
    return cluster.relabel(held, sample).select("cell_idx", whole("cluster_id"))


@query
def project_coords(spark, folder):
    labels = vector_labels(spark, folder).select("cell_idx", (F.col("label") + 1).alias("cluster_id"))  # 0 is no cluster
    near, sample = sampled_knn(spark, folder)
    layout = sample.select("cell_idx", F.slice("vec", 1, 2).alias("vec"))
    placed = embed.project(near, labels, layout)
    return placed.select("cell_idx", rounded(F.col("vec")[0], "x"), rounded(F.col("vec")[1], "y"))


@query
def stream_assignment(spark, folder):
    """The vote of knn_vote, run as a stream over the vectors table."""
    source = T.table(spark, folder, "embeddings")
    stream = (
        spark.readStream.schema(source.schema).parquet(f"{folder}/embeddings.parque[t]")  # as a pattern, a file or a folder of parts
        .select(F.col("vec_id").alias("cell_idx"), F.col("embedding").cast("array<double>").alias("vec"))
    )
    sample = vector_sample(spark, folder)
    labels = materialize(labels_of(spark, folder, sample), "labels")
    out = f"{checkpoint_root(spark)}/cellweave/stream-{uuid.uuid4().hex}"
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
    assign_stream(stream, sample, labels, sink, f"{out}/state", conf=0.3).awaitTermination()
    done = spark.read.schema("cell_idx long, cluster_id long, epoch long").parquet(f"{out}/rows")
    return done.select("cell_idx", "cluster_id")


# ---- markers ----

def supplier_stats(spark, folder) -> DataFrame:
    return markers.rank_statistics(norm_matrix(spark, folder, "supplier"), T.segment_labels(spark, folder))


@query
def marker_means_lfc(spark, folder):
    stats = markers.with_fold_change(supplier_stats(spark, folder))
    return stats.select("gene_idx", whole("cluster_id"), rounded("mean_a"), rounded("mean_b"), rounded("lfc"))


@query
def marker_ranksum_u(spark, folder):
    return supplier_stats(spark, folder).select(
        "gene_idx", whole("cluster_id"), whole("n_a"), whole("n_b"), rounded("u"), whole("ties")
    )


@query
def marker_wilcoxon_z(spark, folder):
    return markers.with_z(supplier_stats(spark, folder)).select("gene_idx", whole("cluster_id"), rounded("z"))


@query
def marker_pvalue(spark, folder):
    tested = markers.with_pvalue(markers.with_z(supplier_stats(spark, folder)))
    return tested.select("gene_idx", whole("cluster_id"), rounded("pvalue"))


@query
def bh_fdr(spark, folder):
    tested = materialize(markers.with_pvalue(markers.with_z(supplier_stats(spark, folder))), "tests")
    return bh_adjust(tested, ["cluster_id"], "pvalue").select("gene_idx", whole("cluster_id"), rounded("qvalue"))


def segment_markers(spark, folder, n: int) -> DataFrame:
    """Top markers of the segments over a stratified sample, with the thresholds of the oracle."""
    labels = materialize(sampling.stratified_sample(T.segment_labels(spark, folder), 100, SEED), "labels")
    tested = markers.test_markers(norm_matrix(spark, folder, "supplier"), labels)
    return markers.top_markers(markers.significant(tested, 0.1, 0.95), n)


@query
def find_markers_topn(spark, folder):
    return segment_markers(spark, folder, 10).select(
        whole("cluster_id"), whole("rn"), "gene_idx", rounded("qvalue"), rounded("lfc")
    )


@query
def markers_wide(spark, folder):
    symbols = T.genes(spark, folder, "supplier").select("gene_idx", "symbol")
    top = segment_markers(spark, folder, 10).join(symbols, "gene_idx")
    return markers.markers_wide(top, range(1, 6)).withColumn("rn", F.col("rn").cast("long"))


# ---- merging and correction ----

def batch_tables(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The supplier matrix with the customers' regions as batches."""
    regions = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("batch"))
    cells = T.cells(spark, folder).join(regions, "nation").select("batch", "cell_idx")
    expr = T.stored_matrix(spark, folder, "supplier").join(cells, "cell_idx")
    batches = T.table(spark, folder, "region").agg(F.collect_list("r_regionkey")).scalar()
    genes = T.genes(spark, folder, "supplier").select("gene_idx", F.explode(batches).alias("batch"))
    return expr.select("batch", "cell_idx", "gene_idx", "count"), cells, genes


@query
def batch_gene_presence(spark, folder):
    regions = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("batch"))
    cells = T.cells(spark, folder).join(regions, "nation").select("batch", "cell_idx")
    present = merge.gene_presence(T.stored_matrix(spark, folder).join(cells, "cell_idx"))
    return present.select("gene_idx", whole("n_batches"), whole("n_cells"))


def merged_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    expr, _, genes = merge.prepare_batches(*batch_tables(spark, folder), ngenes_keep=20)
    n_batches = T.table(spark, folder, "region").count()
    return expr, merge.common_genes(genes, n_batches)


@query
def merge_common_genes(spark, folder):
    return merged_tables(spark, folder)[1]


@query
def merge_counts(spark, folder):
    expr, common = merged_tables(spark, folder)
    return expr.join(common, "gene_idx", "left_semi").select(whole("batch"), "cell_idx", "gene_idx", rounded("count"))


CLOSE, CLOSE_CELLS = 0.1, 0.18


def brand_values(spark, folder) -> DataFrame:
    return norm_matrix(spark, folder, "brand").select("cell_idx", "gene_idx", log2p1("norm").alias("value"))


def brand_pairs(spark, folder) -> DataFrame:
    cells, genes = T.cells(spark, folder).select("cell_idx"), T.genes(spark, folder, "brand")
    return correction.close_gene_pairs(brand_values(spark, folder), cells, genes, CLOSE, CLOSE_CELLS)


@query
def close_gene_pairs(spark, folder):
    return brand_pairs(spark, folder).select("gene1", "gene2", whole("n_close"))


@query
def reduce_genes(spark, folder):
    cells, genes = T.cells(spark, folder).select("cell_idx"), T.genes(spark, folder, "brand")
    kept = correction.reduce_genes(brand_values(spark, folder), cells, genes, CLOSE, CLOSE_CELLS)
    return kept.select("gene_idx")


@query
def rank_transform(spark, folder):
    ranks = correction.rank_transform(norm_matrix(spark, folder, "supplier"), "norm")
    return ranks.select("cell_idx", "gene_idx", rounded("rank", "rank"))


@query
def mnn_pairs(spark, folder):
    held = T.vectors(spark, folder)
    left, right = held.where("label < 5"), held.where("label >= 5")
    pairs = knn.mutual_pairs(left.select("cell_idx", "vec"), right.select("cell_idx", "vec"), correction.MNN_NEIGHBOURS)
    return pairs.select("left_idx", "right_idx", rounded("dist"))


@query
def mnn_shifts(spark, folder):
    """Mean difference of every mutually paired vector to its partners."""
    held = T.vectors(spark, folder)
    left, right = (held.where(side).select("cell_idx", "vec") for side in ("label < 5", "label >= 5"))
    pairs = materialize(knn.mutual_pairs(left, right, correction.MNN_NEIGHBOURS), "pairs")
    shifts = correction.pair_shifts(pairs, left, right).select("cell_idx", F.posexplode("shift").alias("dim", "shift"))
    return shifts.select("cell_idx", whole("dim"), rounded("shift"))


@query
def merge_stack(spark, folder):
    """Two experiments over the same customers, stacked with cell keys of their own."""
    objects = [
        Experiment(
            T.stored_matrix(spark, folder, gene),
            T.cells(spark, folder).select("cell_idx", "cell_id"),
            T.genes(spark, folder, gene),
        )
        for gene in ("supplier", "brand")
    ]
    expr, _, _ = merge.stack(objects)
    return expr.select(whole("batch"), "cell_idx", "gene_idx", rounded("count"))


# ---- figures ----

def vector_points(spark, folder) -> DataFrame:
    layout = T.vectors(spark, folder).select("cell_idx", F.slice("vec", 1, 2).alias("vec"))
    return figures.scatter_points(layout, vector_labels(spark, folder))


@query
def scatter_label_centers(spark, folder):
    centers = figures.label_centers(materialize(vector_points(spark, folder), "points"))
    return centers.select(whole("label"), rounded("x"), rounded("y"), whole("n"))


@query
def scatter_point_size(spark, folder):
    return figures.point_sizes(vector_points(spark, folder)).select(whole("n_points"), rounded("point_size"), rounded("text_size"))


def figure_inputs(spark, folder) -> tuple[DataFrame, DataFrame]:
    labels = materialize(sampling.stratified_sample(T.segment_labels(spark, folder), 100, SEED), "labels")
    genes = materialize(segment_markers(spark, folder, 2).select("gene_idx").distinct(), "genes")
    return labels, genes


@query
def heatmap_zscore(spark, folder):
    labels, genes = figure_inputs(spark, folder)
    scores = figures.z_scores(norm_matrix(spark, folder, "supplier"), labels, genes)
    return scores.select("gene_idx", "cell_idx", rounded("value"), rounded("z"))


@query
def heatmap_label_pos(spark, folder):
    labels = sampling.stratified_sample(T.nation_labels(spark, folder), 40, SEED)
    return figures.label_positions(labels).select("cluster_id", whole("freq"), whole("upto"), whole("pos"))


@query
def marker_violin_stats(spark, folder):
    _, genes = figure_inputs(spark, folder)
    summary = figures.violin_summary(norm_matrix(spark, folder, "supplier"), T.segment_labels(spark, folder), genes)
    return summary.select("gene_idx", whole("cluster_id"), whole("n"), *[rounded(F.col("q")[i], f"q{i}") for i in range(5)])


# ---- names and reshaping ----

@query
def make_unique_names(spark, folder):
    named = make_unique(T.table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return named.select("p_partkey", "p_name", "unique_name")


@query
def strip_barcode_suffix(spark, folder):
    names = T.table(spark, folder, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit("-1")).alias("common"),
        F.concat("c_name", F.when(F.col("c_mktsegment") == "BUILDING", "-2").otherwise("-1")).alias("mixed"),
    )
    return strip_common_suffix(strip_common_suffix(names, "common"), "mixed")


@query
def extract_fields(spark, folder):
    part = T.table(spark, folder, "part")
    return part.select(
        "p_partkey",
        extract_field("p_name", 1, " ").alias("first_word"),
        extract_field("p_name", "2,1", " ").alias("swapped"),
        extract_field("p_brand", 2, "#").alias("brand_no"),
        extract_field("p_brand", 3, "#").alias("absent"),
    )


@query
def zero_pad_names(spark, folder):
    part = T.table(spark, folder, "part")
    total = part.agg(F.count(F.lit(1))).scalar()
    return part.select("p_partkey", zero_padded("gene", F.col("p_partkey") + 1, total).alias("gene_id"))


@query
def wide_to_long_unpivot(spark, folder):
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = T.table(spark, folder, "lineitem").select("l_orderkey", whole("l_linenumber"), *measures)
    long = wide_to_long(lines, ["l_orderkey", "l_linenumber"], measures, "measure", "value")
    return long.select("l_orderkey", "l_linenumber", "measure", rounded("value"))


# ---- model fits: checked by row counts here and by invariants in the tests ----

def supplier_vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Log values of the most variable suppliers for all customers."""
    expr, cells, genes = norm_matrix(spark, folder, "supplier"), T.cells(spark, folder), T.genes(spark, folder, "supplier")
    scores = materialize(hvg.dispersion_scores(materialize(hvg.gene_moments(expr, genes, cells), "moments")), "scores")
    best = materialize(hvg.flag_variable(scores, 1000).where("hvg").select("gene_idx"), "genes")
    return materialize(dense_vectors(expr, cells.select("cell_idx"), best, log2p1("norm")), "vectors"), best


@query
def pca_variance(spark, folder):
    held, _ = supplier_vectors(spark, folder)
    scores, _, shares = pca_genes.principal_components(held, pca_genes.COMPONENTS)
    spread = pca_genes.component_modality(scores)
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("pc"))
    return spread.select(whole("pc"), rounded("modality"), rounded("variance"), rounded(share, "share"))


@query
def density_bins(spark, folder):
    """Binned densities of every dimension of the vectors, as they are taken of component scores."""
    found = pca_genes.density_bins(pca_genes.long_scores(vectors(spark, folder)))
    return found.select(whole("pc"), whole("bin"), rounded("bw"), rounded("low"), rounded("high"), rounded("weight"))


@query
def pca_leading(spark, folder):
    """Variance of all vectors and of their leading component."""
    scores, _, shares = pca_genes.principal_components(materialize(vectors(spark, folder), "vectors"), 3)
    leading = F.var_samp(F.col("vec")[0])
    return scores.agg(rounded(leading / float(shares[0]), "total"), rounded(leading, "leading"))


@query
def pc_gene_topk(spark, folder):
    held, genes = supplier_vectors(spark, folder)
    return pca_genes.top_component_genes(held, genes, 50).select("gene_idx", rounded("score"))


@query
def kmeans_sizes(spark, folder):
    labels = cluster.kmeans_labels(vectors(spark, folder), 10, SEED)
    return labels.groupBy("label").agg(whole(F.count(F.lit(1)), "size"))


@query
def louvain_modularity(spark, folder):
    edges = materialize(partition_edges(spark, folder), "edges")
    return graph.modularity(edges, graph.louvain(edges, SEED)).select(whole("n_edges"), rounded("modularity"))


@query
def linkage_heights(spark, folder):
    """Merge heights of the average-linkage tree in order."""
    held = materialize(vectors(spark, folder), "vectors")
    merges = linkage.tree_merges(linkage.grow_tree(linkage.fit_sample(held)))
    order = Window.partitionBy(F.lit(0)).orderBy("height")  # a bounded sample
    return merges.select(whole(F.row_number().over(order), "turn"), rounded("height"))


@query
def hclust_sizes(spark, folder):
    labels = cluster.cluster_vectors(vectors(spark, folder), "hclust")
    return labels.groupBy("label").agg(whole(F.count(F.lit(1)), "size"))


def layout_rows(layout: DataFrame) -> DataFrame:
    return layout.select("cell_idx", rounded(F.col("vec")[0], "x"), rounded(F.col("vec")[1], "y"))


def link_rows(links: DataFrame) -> DataFrame:
    # one-way weights have eight digits, so more are shown of their combinations
    return links.select(whole("node"), whole("other"), F.round("weight", 12).alias("weight"))


@query
def umap_links(spark, folder):
    return link_rows(embed.umap_links(materialize(vectors(spark, folder), "vectors")))


@query
def tsne_links(spark, folder):
    held = materialize(vectors(spark, folder), "vectors")
    return link_rows(embed.tsne_links(held, held.count()))


@query
def umap_embed(spark, folder):
    return layout_rows(embed.fit_umap(vectors(spark, folder), 2, seed=SEED))


@query
def tsne_embed(spark, folder):
    return layout_rows(embed.fit_tsne(vectors(spark, folder), 2, seed=SEED))


@query
def fastmnn_correct(spark, folder):
    batches = vector_labels(spark, folder).select("cell_idx", (F.col("label") < 5).cast("int").alias("batch"))
    moved = correction.mutual_neighbour_correction(vectors(spark, folder), batches, [0, 1])
    return moved.select("cell_idx", rounded(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), "squared_norm"))
