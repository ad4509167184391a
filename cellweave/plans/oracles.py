"""The catalogue's queries as plain SQL over the same tables.

Fragments are named sub-queries; a query lists the ones it needs in order.
"""

from __future__ import annotations

from cellweave.functions.numeric import erfc_sql
from cellweave.operators.hvg import BIN_PROBS
from cellweave.operators.sampling import parameter_grid

SEED = 7


def matrix(gene: str) -> str:
    source = "lineitem JOIN orders ON l_orderkey = o_orderkey"
    column = {"part": "l_partkey", "supplier": "l_suppkey", "brand": "CAST(substring(p_brand, 7) AS BIGINT)"}[gene]
    if gene == "brand":
        source += " JOIN part ON l_partkey = p_partkey"
    return f"""
    expr AS (SELECT o_custkey AS cell_idx, {column} AS gene_idx, sum(l_quantity) AS cnt
             FROM {source} GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
    cells AS (SELECT c_custkey AS cell_idx FROM customer),
    totals AS (SELECT cell_idx, coalesce(sum(cnt), 0) AS total FROM cells LEFT JOIN expr USING (cell_idx) GROUP BY cell_idx),
    norm AS (SELECT cell_idx, gene_idx, cnt, cnt / (total / (SELECT median(total) FROM totals)) AS norm
             FROM expr JOIN totals USING (cell_idx) WHERE total <> 0)"""


GENES = {
    "part": "genes AS (SELECT p_partkey AS gene_idx FROM part)",
    "supplier": "genes AS (SELECT s_suppkey AS gene_idx FROM supplier)",
    "brand": "genes AS (SELECT DISTINCT CAST(substring(p_brand, 7) AS BIGINT) AS gene_idx FROM part)",
}

PROBS = "[" + ", ".join(str(p) for p in BIN_PROBS) + "]"

MOMENTS = """
    n_cells AS (SELECT count(*) AS n FROM cells),
    means AS (SELECT gene_idx, count(norm) AS nnz, coalesce(sum(norm), 0) / (SELECT n FROM n_cells) AS mean
              FROM genes LEFT JOIN norm USING (gene_idx) GROUP BY gene_idx),
    squares AS (SELECT gene_idx, sum(power(norm - mean, 2)) AS ss FROM norm JOIN means USING (gene_idx) GROUP BY gene_idx),
    moments AS (SELECT gene_idx, nnz, mean,
                  (coalesce(ss, 0) + (n - nnz) * mean * mean) / (n - 1) AS variance,
                  (coalesce(ss, 0) + (n - nnz) * mean * mean) / (n - 1) / nullif(mean, 0) AS dispersion
                FROM means LEFT JOIN squares USING (gene_idx), n_cells)"""

BINS = f"""
    edges AS (SELECT quantile_cont(mean, {PROBS}) AS e FROM moments),
    bins AS (SELECT moments.*, 1 + len(list_filter(e, lambda x: x < mean)) AS bin FROM moments, edges)"""

SPREAD = """
    spread AS (SELECT bin, count(*) AS n_genes, median(dispersion) AS bin_median, mad(dispersion) * 1.4826 AS bin_mad
               FROM bins GROUP BY bin)"""

SCORES = """
    scores AS (SELECT gene_idx, bin, abs(dispersion - bin_median) / bin_mad AS dispersion_norm FROM bins JOIN spread USING (bin)),
    cutoff AS (SELECT min(dispersion_norm) AS c FROM (SELECT dispersion_norm FROM scores WHERE dispersion_norm IS NOT NULL
               ORDER BY dispersion_norm DESC LIMIT 1000))"""


def drawn(name: str, source: str, ident: str, quota: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}, {ident}" if by else ident
    return f"""
    {name} AS (SELECT {keep} FROM (
        SELECT {keep}, row_number() OVER ({part} ORDER BY md5('{SEED}_' || {ident}), {ident}) AS rn,
               count(*) OVER ({part}) AS size FROM {source}) WHERE rn <= {quota})"""


SEGMENT = "labels AS (SELECT c_custkey AS cell_idx, dense_rank() OVER (ORDER BY c_mktsegment) AS cluster_id FROM customer)"
NATION = "nations AS (SELECT c_custkey AS cell_idx, c_nationkey + 1 AS cluster_id FROM customer)"


def quota(size: str, pinit, pfin, scale) -> str:
    return f"CAST(round_even(({pinit} + exp(-{size} / {scale}) * ({pfin} - {pinit})) * {size}, 0) AS BIGINT)"


VECTORS = "vecs AS (SELECT vec_id AS cell_idx, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
SAMPLE = drawn("picked", "vecs", "cell_idx", "250") + ", sample AS (SELECT * FROM vecs SEMI JOIN picked USING (cell_idx))"


def neighbours(name: str, queries: str, samples: str, k: int) -> str:
    return f"""
    {name}_all AS (SELECT q.cell_idx, s.cell_idx AS nn_cell_idx,
                     round(1 - list_cosine_similarity(q.vec, s.vec), 10) AS dist FROM {queries} q, {samples} s),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_idx ORDER BY dist, nn_cell_idx) AS nn_rank
               FROM {name}_all) WHERE nn_rank <= {k})"""


def others(k: int) -> str:
    """Every vector's ``k`` nearest others by Euclidean distance, as lists."""
    return f"""
    others AS (SELECT cell_idx, list(nn ORDER BY dist, nn) AS nn, list(dist ORDER BY dist, nn) AS dist FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_idx ORDER BY dist, nn) AS r FROM (
            SELECT q.cell_idx, s.cell_idx AS nn, round(list_distance(q.vec, s.vec), 10) AS dist FROM vecs q, vecs s WHERE q.cell_idx <> s.cell_idx))
        WHERE r <= {k} GROUP BY cell_idx)"""


def solved(values: str, total: str, goal: str, weight: str, combined: str) -> tuple[str, ...]:
    """Bisection of a scale per row, weights of the lists and the combined weight of every pair."""
    return (
        f"start AS (SELECT cell_idx, nn, {values} AS x FROM others)",
        f"""solve(cell_idx, nn, x, low, high, turn) AS (
        SELECT cell_idx, nn, x, 1e-12::DOUBLE, 1e12::DOUBLE, 0 FROM start
        UNION ALL
        SELECT cell_idx, nn, x, CASE WHEN above THEN low ELSE mid END, CASE WHEN above THEN mid ELSE high END, turn + 1 FROM (
            SELECT *, {total} > {goal} AS above FROM (SELECT *, sqrt(low * high) AS mid FROM solve WHERE turn < 80)))""",
        f"""weighted AS (SELECT cell_idx, nn, round(w, 8) AS w FROM (
        SELECT cell_idx, unnest(nn) AS nn, unnest({weight}) AS w FROM (SELECT *, sqrt(low * high) AS mid FROM solve WHERE turn = 80)))""",
        f"""pairs AS (SELECT least(cell_idx, nn) AS a, greatest(cell_idx, nn) AS b, {combined} AS weight FROM weighted GROUP BY 1, 2)""",
    )


FUZZY = solved(
    "list_transform(dist, lambda d: greatest(d - coalesce(list_min(list_filter(dist, lambda y: y > 0)), 0), 0))",
    "list_sum(list_transform(x, lambda v: exp(-v / mid)))", "log2(len(x) + 1)", "list_transform(x, lambda v: exp(-v / mid))",
    "sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END")
PERPLEXED = solved(
    "list_transform(dist, lambda d: d * d - list_min(dist) * list_min(dist))",
    "ln(list_sum(list_transform(x, lambda v: exp(-v / mid)))) + list_sum(list_transform(x, lambda v: exp(-v / mid) * v))"
    " / (list_sum(list_transform(x, lambda v: exp(-v / mid))) * mid)",
    "ln(greatest(1.0, least(15, len(x) / 3)))",
    "list_transform(x, lambda v: exp(-v / mid) / list_sum(list_transform(x, lambda y: exp(-y / mid))))",
    "sum(w) / (2.0 * (SELECT count(*) FROM vecs))")
LINKS = ("SELECT CAST(a AS BIGINT) AS node, CAST(b AS BIGINT) AS other, round(weight, 12) AS weight FROM pairs"
         " UNION ALL SELECT CAST(b AS BIGINT), CAST(a AS BIGINT), round(weight, 12) FROM pairs")
LEADING = (
    "long AS (SELECT cell_idx, unnest(vec) AS v, unnest(range(len(vec))) AS d FROM vecs)",
    "centred AS (SELECT cell_idx, d, v - avg(v) OVER (PARTITION BY d) AS v FROM long)",
    "cov AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) / ((SELECT count(*) FROM vecs) - 1) AS c FROM centred a JOIN centred b USING (cell_idx) GROUP BY 1, 2)",
    "matrix AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i))",
    """powered(v, size, turn) AS (
        SELECT list_transform(range(len(m)), lambda i: 1 + i::DOUBLE / 100), 0.0::DOUBLE, 0 FROM matrix
        UNION ALL
        SELECT list_transform(w, lambda x: x / s), s, turn + 1 FROM (
            SELECT w, sqrt(list_dot_product(w, w)) AS s, turn FROM (
                SELECT list_transform(m, lambda r: list_dot_product(r, v)) AS w, turn FROM powered, matrix WHERE turn < 1500)))""",
)
LINKAGE = (
    "near AS (SELECT q.cell_idx AS a, s.cell_idx AS b,"
    " round(acos(greatest(-1.0, least(1.0, list_cosine_similarity(q.vec, s.vec)))) / pi(), 12) AS d FROM vecs q JOIN vecs s ON q.cell_idx <> s.cell_idx)",
    """tree(a, b, d, size_a, size_b, turn) USING KEY (a, b) AS (
        SELECT a, b, d, 1::BIGINT, 1::BIGINT, 0::BIGINT FROM near
        UNION (
        WITH best AS (SELECT d, a, b, size_a, size_b FROM recurring.tree WHERE a < b AND d IS NOT NULL ORDER BY d, a, b LIMIT 1),
        step AS (SELECT max(turn) + 1 AS turn FROM recurring.tree),
        moved AS (
            SELECT x.b AS c, x.size_b AS size_c, (best.size_a * x.d + best.size_b * y.d) / (best.size_a + best.size_b) AS d
            FROM best JOIN recurring.tree x ON x.a = best.a AND x.b <> best.b AND x.d IS NOT NULL
            JOIN recurring.tree y ON y.a = best.b AND y.b = x.b)
        SELECT best.a, moved.c, moved.d, best.size_a + best.size_b, size_c, turn FROM best, moved, step
        UNION ALL SELECT moved.c, best.a, moved.d, size_c, best.size_a + best.size_b, turn FROM best, moved, step
        UNION ALL SELECT best.b, c, NULL, 0, 0, turn FROM best, moved, step
        UNION ALL SELECT c, best.b, NULL, 0, 0, turn FROM best, moved, step
        UNION ALL SELECT best.a, best.b, NULL, 0, 0, turn FROM best, step
        UNION ALL SELECT best.b, best.a, NULL, 0, 0, turn FROM best, step
        UNION ALL SELECT -turn, -turn, best.d, 0, 0, turn FROM best, step))""",
)
KNN = neighbours("knn", "vecs", "sample", 11)
EDGES = neighbours("nn", "vecs", "vecs", 6) + """,
    edges AS (SELECT DISTINCT least(cell_idx, nn_cell_idx) AS src, greatest(cell_idx, nn_cell_idx) AS dst
              FROM nn WHERE cell_idx <> nn_cell_idx)"""
VOTES = """
    ballots AS (SELECT knn.cell_idx, sample.label, count(*) AS votes FROM knn JOIN sample ON sample.cell_idx = nn_cell_idx GROUP BY 1, 2),
    won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_idx ORDER BY votes DESC, label) AS rn FROM ballots) WHERE rn = 1),
    votes AS (SELECT cell_idx, CAST(11 AS BIGINT) AS n_neighbours, CAST(label AS BIGINT) AS label, votes FROM won)"""


def assigned(conf: float) -> str:
    return f"CASE WHEN votes / 11.0 > {conf} THEN label END"


RELABEL = f"""
    given AS (SELECT cell_idx, {assigned(0.3)} AS assigned FROM votes),
    held AS (SELECT DISTINCT assigned FROM given SEMI JOIN sample USING (cell_idx) WHERE assigned IS NOT NULL),
    numbered AS (SELECT assigned, row_number() OVER (ORDER BY assigned) AS cluster_id FROM held)"""


def rank_tests(labels: str) -> str:
    """Dense Mann-Whitney: every gene and cell, zeros included."""
    return f"""
    sizes AS (SELECT cluster_id, count(*) AS n_a FROM {labels} GROUP BY cluster_id),
    n_all AS (SELECT count(*) AS n FROM {labels}),
    seen AS (SELECT DISTINCT gene_idx FROM norm SEMI JOIN {labels} USING (cell_idx)),
    dense AS (SELECT gene_idx, cell_idx, cluster_id, coalesce(norm, 0) AS v
              FROM (SELECT * FROM seen, {labels}) LEFT JOIN norm USING (gene_idx, cell_idx)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY gene_idx ORDER BY v)
                 + (count(*) OVER (PARTITION BY gene_idx, v) - 1) / 2.0 AS r FROM dense),
    tie AS (SELECT gene_idx, sum(power(t, 3) - t) AS ties, FROM (SELECT gene_idx, v, count(*) AS t FROM dense GROUP BY 1, 2) GROUP BY 1),
    per AS (SELECT gene_idx, cluster_id, count(*) AS n_a, sum(r) AS rs, sum(v) AS sv FROM ranked GROUP BY 1, 2),
    al AS (SELECT gene_idx, sum(v) AS sv_all FROM dense GROUP BY 1),
    stats AS (SELECT gene_idx, cluster_id, n_a, n - n_a AS n_b, sv / n_a AS mean_a, (sv_all - sv) / (n - n_a) AS mean_b,
                rs - n_a * (n_a + 1) / 2.0 AS u, ties FROM per JOIN al USING (gene_idx) JOIN tie USING (gene_idx), n_all),
    tested AS (SELECT *, log2(nullif(mean_a / nullif(mean_b, 0), 0)) AS lfc,
                (u - n_a * n_b / 2.0 - 0.5 * sign(u - n_a * n_b / 2.0))
                / nullif(sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))), 0) AS z FROM stats),
    halves AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM tested),
    pvalues AS (SELECT *, least(1.0, {erfc_sql("x", "")}) AS pvalue FROM halves),
    bh AS (SELECT *, pvalue * count(*) OVER (PARTITION BY cluster_id)
             / row_number() OVER (PARTITION BY cluster_id ORDER BY pvalue) AS raw FROM pvalues WHERE pvalue IS NOT NULL),
    qvalues AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY cluster_id ORDER BY pvalue DESC)) AS qvalue FROM bh)"""


SAMPLED_LABELS = drawn("sampled", "labels", "cell_idx", "100", "cluster_id")


def top_markers(n: int) -> str:
    return f"""
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY qvalue, abs(lfc), gene_idx) AS rn
            FROM qvalues WHERE lfc > 0 AND abs(lfc) >= 0.1 AND qvalue <= 0.95) WHERE rn <= {n})"""


SUPPLIER_TESTS = [matrix("supplier"), SEGMENT, rank_tests("labels")]
SAMPLED_TESTS = [matrix("supplier"), SEGMENT, SAMPLED_LABELS, rank_tests("sampled")]

BATCHES = f"""
    expr AS (SELECT n_regionkey AS batch, o_custkey AS cell_idx, l_suppkey AS gene_idx, sum(l_quantity) AS cnt
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING sum(l_quantity) <> 0),
    cells AS (SELECT n_regionkey AS batch, c_custkey AS cell_idx FROM customer JOIN nation ON c_nationkey = n_nationkey),
    support AS (SELECT batch, cell_idx, count(*) FILTER (cnt >= 3) AS s FROM cells LEFT JOIN expr USING (batch, cell_idx) GROUP BY 1, 2),
    bounds AS (SELECT batch, quantile_cont(s, 0.001) AS l1, max(s) AS l2 FROM support GROUP BY batch),
    good AS (SELECT batch, cell_idx FROM support JOIN bounds USING (batch) WHERE s BETWEEN l1 AND l2),
    e2 AS (SELECT * FROM expr SEMI JOIN good USING (cell_idx)),
    genes AS (SELECT batch, gene_idx FROM e2 GROUP BY 1, 2 HAVING count(*) FILTER (cnt > 1) > 1),
    e3 AS (SELECT * FROM e2 SEMI JOIN genes USING (batch, gene_idx)),
    totals AS (SELECT batch, cell_idx, coalesce(sum(cnt), 0) AS total FROM good LEFT JOIN e3 USING (batch, cell_idx) GROUP BY 1, 2),
    mid AS (SELECT batch, median(total) AS m, count(*) AS n FROM totals GROUP BY batch),
    norm AS (SELECT batch, cell_idx, gene_idx, cnt, cnt / (total / m) AS norm FROM e3 JOIN totals USING (batch, cell_idx) JOIN mid USING (batch)),
    means AS (SELECT batch, gene_idx, count(*) AS nnz, sum(norm) / any_value(n) AS mean, any_value(n) AS n
              FROM norm JOIN mid USING (batch) GROUP BY 1, 2),
    moments AS (SELECT batch, gene_idx, any_value(mean) AS mean,
                  (sum(power(norm - mean, 2)) + any_value((n - nnz) * mean * mean)) / any_value(n - 1) / any_value(mean) AS dispersion
                FROM norm JOIN means USING (batch, gene_idx) GROUP BY 1, 2),
    edges AS (SELECT batch, quantile_cont(mean, {PROBS}) AS e FROM moments GROUP BY batch),
    bins AS (SELECT moments.*, 1 + len(list_filter(e, lambda x: x < mean)) AS bin FROM moments JOIN edges USING (batch)),
    spread AS (SELECT batch, bin, median(dispersion) AS bm, mad(dispersion) * 1.4826 AS bs FROM bins GROUP BY 1, 2),
    scores AS (SELECT batch, gene_idx, CASE WHEN bs <> 0 THEN abs(dispersion - bm) / bs
                 WHEN abs(dispersion - bm) > 0 THEN CAST('infinity' AS DOUBLE) END AS d FROM bins JOIN spread USING (batch, bin)),
    cut AS (SELECT batch, min(d) AS c FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY d DESC) AS rn
            FROM scores WHERE d IS NOT NULL) WHERE rn <= 20 GROUP BY batch),
    common AS (SELECT gene_idx FROM scores JOIN cut USING (batch) GROUP BY gene_idx
               HAVING count(DISTINCT batch) = (SELECT count(*) FROM region) AND bool_or(coalesce(d >= c, false)))"""

CLOSE_PAIRS = """
    vals AS (SELECT gene_idx, cell_idx, log2(coalesce(norm, 0) + 1) AS v FROM (SELECT * FROM genes, cells) LEFT JOIN norm USING (gene_idx, cell_idx)),
    orders_ AS (SELECT gene_idx, lag(gene_idx) OVER (PARTITION BY cell_idx ORDER BY v, gene_idx) AS before FROM vals),
    adjacent AS (SELECT DISTINCT least(gene_idx, before) AS gene1, greatest(gene_idx, before) AS gene2 FROM orders_ WHERE before IS NOT NULL),
    close AS (SELECT a.gene_idx AS gene1, b.gene_idx AS gene2, count(*) AS n_close
              FROM vals a JOIN vals b ON a.cell_idx = b.cell_idx AND a.gene_idx < b.gene_idx
              WHERE least(a.v, b.v) >= 0.001 AND (greatest(a.v, b.v) - least(a.v, b.v)) / least(a.v, b.v) < 0.1 GROUP BY 1, 2),
    pairs AS (SELECT close.* FROM close SEMI JOIN adjacent USING (gene1, gene2) WHERE n_close > 0.18 * (SELECT count(*) FROM cells))"""

MNN = ("lefts AS (SELECT * FROM vecs WHERE label < 5), rights AS (SELECT * FROM vecs WHERE label >= 5),"
       + neighbours("forth", "lefts", "rights", 20) + "," + neighbours("back", "rights", "lefts", 20))

FIGURE_GENES = "chosen AS (SELECT DISTINCT gene_idx FROM top)"


def sql(select: str, *fragments: str) -> str:
    return (f"WITH {', '.join(f.strip() for f in fragments)} " if fragments else "") + select


def _grid() -> str:
    grid = parameter_grid()
    return ", ".join(f"(SELECT unnest({values}) AS {name})" for name, values in grid.items())


def oracles() -> dict[str, str]:
    part, part_genes = matrix("part"), GENES["part"]
    moments = [part, part_genes, MOMENTS]
    q = {
        "count_matrix": sql("SELECT cell_idx, gene_idx, round(cnt, 6) AS count FROM expr", part),
        "cell_totals": sql("SELECT cell_idx, round(total, 6) AS total FROM totals", part),
        "filter_cells": sql(
            "SELECT cell_idx, n_genes FROM support, (SELECT quantile_cont(n_genes, 0.05) AS lo, quantile_cont(n_genes, 0.95) AS hi FROM support)"
            " WHERE n_genes BETWEEN lo AND hi",
            part, "support AS (SELECT cell_idx, count(*) FILTER (cnt >= 10) AS n_genes FROM cells LEFT JOIN expr USING (cell_idx) GROUP BY 1)"),
        "filter_genes": sql(
            "SELECT gene_idx, count(*) FILTER (cnt > 20) AS n_cells FROM genes LEFT JOIN expr USING (gene_idx) GROUP BY 1 HAVING count(*) FILTER (cnt > 20) > 18",
            part, part_genes),
        "count_normalize": sql("SELECT cell_idx, gene_idx, round(norm, 6) AS norm FROM norm", part),
        "log2_normalize": sql("SELECT cell_idx, gene_idx, round(log2(norm + 1), 6) AS logcount FROM norm", part),
        "gene_mean_var": sql("SELECT gene_idx, nnz, round(mean, 6) AS mean, round(variance, 6) AS variance FROM moments", *moments),
        "gene_dispersion": sql("SELECT gene_idx, round(dispersion, 6) AS dispersion FROM moments", *moments),
        "gene_bins": sql("SELECT gene_idx, bin FROM bins", *moments, BINS),
        "bin_dispersion_stats": sql(
            "SELECT bin, n_genes, round(bin_median, 6) AS bin_median, round(bin_mad, 6) AS bin_mad FROM spread", *moments, BINS, SPREAD),
        "rank_genes_hvg": sql(
            "SELECT gene_idx, bin, round(dispersion_norm, 6) AS dispersion_norm, dispersion_norm >= c AS hvg FROM scores, cutoff",
            *moments, BINS, SPREAD, SCORES),
        "presample": sql(
            "SELECT cell_idx FROM kept",
            "lines AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS cell_idx FROM lineitem)",
            drawn("kept", "lines", "cell_idx", "CASE WHEN size < 20000 THEN size ELSE least(20000, round_even(size / 3, 0)) END")),
        "random_sample": sql(
            "SELECT cell_idx FROM kept", "cells AS (SELECT c_custkey AS cell_idx FROM customer)",
            drawn("kept", "cells", "cell_idx", "500")),
        "stratified_sample": sql("SELECT cell_idx, CAST(cluster_id AS BIGINT) AS cluster_id FROM kept", NATION,
                                 drawn("kept", "nations", "cell_idx", "40", "cluster_id")),
        "sps_quota": sql(
            f"SELECT CAST(cluster_id AS BIGINT) AS part, size, {quota('size', 0.195, 0.9, 500.0)} AS quota FROM sizes",
            SEGMENT, "sizes AS (SELECT cluster_id, count(*) AS size FROM labels GROUP BY 1)"),
        "sps_sample": sql("SELECT cell_idx, CAST(cluster_id AS BIGINT) AS part FROM kept", SEGMENT,
                          drawn("kept", "labels", "cell_idx", quota("size", 0.195, 0.9, 500.0), "cluster_id")),
        "sps_param_search": sql(
            "SELECT round(pinit, 6) AS pinit, round(pfin, 6) AS pfin, round(scale, 6) AS scale, CAST(total AS BIGINT) AS total,"
            " CAST(miss AS BIGINT) AS miss FROM missed ORDER BY miss, pinit, pfin, scale LIMIT 1",
            SEGMENT, "sizes AS (SELECT cluster_id, count(*) AS size FROM labels GROUP BY 1)",
            f"grid AS (SELECT * FROM {_grid()})",
            f"totals AS (SELECT pinit, pfin, scale, sum({quota('size', 'pinit', 'pfin', 'scale')}) AS total, sum(size) AS n FROM sizes, grid GROUP BY 1, 2, 3)",
            "missed AS (SELECT *, abs(total - least(n, 1000)) AS miss FROM totals)"),
        "knn_exact": sql("SELECT cell_idx, nn_rank, nn_cell_idx, round(dist, 6) AS dist FROM knn", VECTORS, SAMPLE, KNN),
        "read_10x_types": (
            "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Gene Expression' ELSE 'Antibody Capture' END AS feature_type,"
            " CASE WHEN o_custkey % 2 = 0 THEN 'even_' ELSE 'odd_' END || c_name AS cell_id, s_name AS symbol, CAST(sum(l_quantity) AS DOUBLE) AS count"
            " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
            " GROUP BY l_suppkey, o_custkey, c_name, s_name HAVING sum(l_quantity) <> 0"),
        "read_delimited": (
            "SELECT 'brand ' || substring(p_brand, 7) AS barcode, 'customer, ' || o_custkey AS symbol, CAST(sum(l_quantity) AS DOUBLE) AS count"
            " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand, o_custkey HAVING sum(l_quantity) <> 0"),
        "knn_indexed": sql(
            "SELECT cell_idx, nn_rank, nn_cell_idx, round(dist, 6) AS dist FROM found", VECTORS,
            "asked AS (SELECT * FROM vecs WHERE cell_idx % 20 = 0)", neighbours("found", "asked", "vecs", 11)),
        "umap_links": "WITH RECURSIVE " + sql(LINKS, VECTORS, others(15), *FUZZY).removeprefix("WITH "),
        "tsne_links": "WITH RECURSIVE " + sql(LINKS, VECTORS, others(45), *PERPLEXED).removeprefix("WITH "),
        "linkage_heights": "WITH RECURSIVE " + sql("SELECT -a AS turn, round(d, 6) AS height FROM tree WHERE a < 0", VECTORS, *LINKAGE).removeprefix("WITH "),
        "density_bins": sql(
            "SELECT pc, CAST(bin AS BIGINT) AS bin, round(bw, 6) AS bw, round(low, 6) AS low, round(high, 6) AS high, round(sum(w) / n, 6) AS weight"
            " FROM (SELECT pc, bw, low, high, n, floor(place) AS bin, 1 - (place - floor(place)) AS w FROM placed"
            " UNION ALL SELECT pc, bw, low, high, n, floor(place) + 1, place - floor(place) FROM placed) GROUP BY pc, bin, bw, low, high, n", VECTORS,
            "scores AS (SELECT unnest(vec) AS v, unnest(range(len(vec))) AS pc FROM vecs)",
            "widths AS (SELECT pc, count(*) AS n, min(v) AS lowest, max(v) AS highest, stddev_samp(v) AS sd,"
            " (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM scores GROUP BY pc)",
            "bands AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(n, -0.2) AS bw FROM widths)",
            "spans AS (SELECT pc, n, bw, lowest - 3 * bw AS low, highest + 3 * bw AS high FROM bands WHERE bw > 0)",
            "placed AS (SELECT pc, n, bw, low, high, (v - low + 4 * bw) / ((high - low + 8 * bw) / 511) AS place FROM scores JOIN spans USING (pc))"),
        "pca_leading": "WITH RECURSIVE " + sql(
            "SELECT round((SELECT sum(c) FROM cov WHERE i = j), 6) AS total, round(size, 6) AS leading FROM powered WHERE turn = 1500",
            VECTORS, *LEADING).removeprefix("WITH "),
        "knn_graph_edges": sql("SELECT src, dst FROM edges", VECTORS, EDGES),
        "graph_degree": sql("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1", VECTORS, EDGES),
        "modularity": sql(
            "SELECT CAST(m AS BIGINT) AS n_edges, round((SELECT count(*) FILTER (a = b) FROM ends) / m - (SELECT sum(d * d) FROM deg) / (4.0 * m * m), 6) AS modularity"
            " FROM (SELECT count(*) AS m FROM ends)",
            VECTORS, EDGES,
            "ends AS (SELECT x.label AS a, y.label AS b FROM edges JOIN vecs x ON x.cell_idx = src JOIN vecs y ON y.cell_idx = dst)",
            "deg AS (SELECT c, count(*) AS d FROM (SELECT a AS c FROM ends UNION ALL SELECT b FROM ends) GROUP BY 1)"),
        "knn_vote": sql(f"SELECT *, {assigned(0.1)} AS assigned FROM votes", VECTORS, SAMPLE, KNN, VOTES),
        "knn_vote_conf_sweep": sql(
            "SELECT conf, CAST(count(*) FILTER (votes / 11.0 > conf) AS BIGINT) AS assigned, count(*) AS cells FROM votes,"
            " (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.75]) AS DOUBLE) AS conf) GROUP BY conf", VECTORS, SAMPLE, KNN, VOTES),
        "unassigned_count": sql(
            f"SELECT count(*) FILTER (({assigned(0.3)}) IS NULL) AS unassigned, count(*) AS cells FROM votes", VECTORS, SAMPLE, KNN, VOTES),
        "relabel_clusters": sql("SELECT cell_idx, cluster_id FROM given LEFT JOIN numbered USING (assigned)", VECTORS, SAMPLE, KNN, VOTES, RELABEL),
        "project_coords": sql(
            "SELECT c.cell_idx, round(avg(s.vec[1]), 6) AS x, round(avg(s.vec[2]), 6) AS y FROM knn JOIN vecs c USING (cell_idx)"
            " JOIN sample s ON s.cell_idx = nn_cell_idx AND s.label = c.label GROUP BY 1", VECTORS, SAMPLE, KNN),
        "stream_assignment": sql(f"SELECT cell_idx, {assigned(0.3)} AS cluster_id FROM votes", VECTORS, SAMPLE, KNN, VOTES),
        "marker_means_lfc": sql(
            "SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(lfc, 6) AS lfc FROM tested",
            *SUPPLIER_TESTS),
        "marker_ranksum_u": sql(
            "SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, n_a, n_b, round(u, 6) AS u, CAST(ties AS BIGINT) AS ties FROM stats", *SUPPLIER_TESTS),
        "marker_wilcoxon_z": sql("SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, round(z, 6) AS z FROM tested", *SUPPLIER_TESTS),
        "marker_pvalue": sql("SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, round(pvalue, 6) AS pvalue FROM pvalues", *SUPPLIER_TESTS),
        "bh_fdr": sql("SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, round(qvalue, 6) AS qvalue FROM qvalues", *SUPPLIER_TESTS),
        "find_markers_topn": sql(
            "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, rn, gene_idx, round(qvalue, 6) AS qvalue, round(lfc, 6) AS lfc FROM top",
            *SAMPLED_TESTS, top_markers(10)),
        "markers_wide": sql(
            "SELECT rn, " + ", ".join(f"coalesce(max(CASE WHEN cluster_id = {c} THEN s_name END), '') AS cluster_{c}" for c in range(1, 6))
            + " FROM top JOIN supplier ON s_suppkey = gene_idx GROUP BY rn", *SAMPLED_TESTS, top_markers(10)),
        "batch_gene_presence": (
            "SELECT l_partkey AS gene_idx, count(DISTINCT n_regionkey) AS n_batches, count(DISTINCT o_custkey) AS n_cells FROM lineitem"
            " JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
        "merge_common_genes": sql("SELECT gene_idx FROM common", BATCHES),
        "merge_counts": sql(
            "SELECT CAST(batch AS BIGINT) AS batch, cell_idx, gene_idx, round(cnt, 6) AS count FROM e3 SEMI JOIN common USING (gene_idx)", BATCHES),
        "close_gene_pairs": sql("SELECT gene1, gene2, n_close FROM pairs", matrix("brand"), GENES["brand"], CLOSE_PAIRS),
        "reduce_genes": sql(
            "SELECT gene_idx FROM genes WHERE gene_idx NOT IN (SELECT gene1 FROM pairs)", matrix("brand"), GENES["brand"], CLOSE_PAIRS),
        "rank_transform": sql(
            "SELECT cell_idx, gene_idx, round(rank() OVER (PARTITION BY cell_idx ORDER BY norm)"
            " + (count(*) OVER (PARTITION BY cell_idx, norm) - 1) / 2.0, 6) AS rank FROM norm", matrix("supplier")),
        "mnn_pairs": sql(
            "SELECT f.cell_idx AS left_idx, f.nn_cell_idx AS right_idx, round(f.dist, 6) AS dist FROM forth f"
            " JOIN back b ON b.cell_idx = f.nn_cell_idx AND b.nn_cell_idx = f.cell_idx", VECTORS, MNN),
        "mnn_shifts": sql(
            "SELECT p.cell_idx, CAST(dim - 1 AS BIGINT) AS dim, round(avg(l.vec[dim] - r.vec[dim]), 6) + 0.0 AS shift FROM"
            " (SELECT b.cell_idx, b.nn_cell_idx FROM forth f JOIN back b ON b.cell_idx = f.nn_cell_idx AND b.nn_cell_idx = f.cell_idx) p"
            " JOIN lefts l ON l.cell_idx = p.nn_cell_idx JOIN rights r ON r.cell_idx = p.cell_idx,"
            " (SELECT unnest(range(1, (SELECT max(len(vec)) FROM vecs) + 1)) AS dim) GROUP BY 1, 2", VECTORS, MNN),
        "merge_stack": (
            f"WITH one AS (WITH {matrix('supplier')} SELECT * FROM expr), two AS (WITH {matrix('brand')} SELECT * FROM expr),"
            " ends AS (SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer)"
            " SELECT CAST(1 AS BIGINT) AS batch, cell_idx - low AS cell_idx, gene_idx, round(cnt, 6) AS count FROM one, ends"
            " UNION ALL SELECT 2, cell_idx - low + high - low + 1, gene_idx, round(cnt, 6) FROM two, ends"),
        "scatter_label_centers": sql(
            "SELECT CAST(label AS BIGINT) AS label, round(median(vec[1]), 6) AS x, round(median(vec[2]), 6) AS y, count(*) AS n FROM vecs GROUP BY label", VECTORS),
        "scatter_point_size": sql(
            "SELECT n AS n_points, round(-0.58 * ln(n) + 6.77, 6) AS point_size, round(greatest(2 * (-0.58 * ln(n) + 6.77), 3), 6) AS text_size"
            " FROM (SELECT count(*) AS n FROM vecs)", VECTORS),
        "heatmap_zscore": sql(
            "SELECT gene_idx, cell_idx, round(v, 6) AS value, round((v - avg(v) OVER g) / nullif(stddev_samp(v) OVER g, 0), 6) AS z FROM cellvals WINDOW g AS (PARTITION BY gene_idx)",
            *SAMPLED_TESTS, top_markers(2), FIGURE_GENES,
            "cellvals AS (SELECT gene_idx, cell_idx, log2(coalesce(norm, 0) + 1) AS v FROM (SELECT * FROM chosen, sampled) LEFT JOIN norm USING (gene_idx, cell_idx))"),
        "heatmap_label_pos": sql(
            "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, freq, CAST(sum(freq) OVER (ORDER BY cluster_id) AS BIGINT) AS upto,"
            " CAST(round_even((2 * sum(freq) OVER (ORDER BY cluster_id) - freq) / 2.0, 0) AS BIGINT) AS pos FROM (SELECT cluster_id, count(*) AS freq FROM kept GROUP BY 1)",
            NATION, drawn("kept", "nations", "cell_idx", "40", "cluster_id")),
        "marker_violin_stats": sql(
            "SELECT gene_idx, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, "
            + ", ".join(f"round(quantile_cont(v, {p}), 6) AS q{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM cellvals GROUP BY 1, 2",
            *SAMPLED_TESTS, top_markers(2), FIGURE_GENES,
            "cellvals AS (SELECT gene_idx, cluster_id, log2(coalesce(norm, 0) + 1) AS v FROM (SELECT * FROM chosen, labels) LEFT JOIN norm USING (gene_idx, cell_idx))"),
        "make_unique_names": (
            "SELECT p_partkey, p_name, CASE WHEN rn = 1 THEN p_name ELSE p_name || '.' || (rn - 1) END AS unique_name"
            " FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)"),
        "strip_barcode_suffix": sql(
            "SELECT c_custkey, CASE WHEN (SELECT bool_and(common LIKE '%-1') FROM names) THEN split_part(common, '-', 1) ELSE common END AS common,"
            " CASE WHEN (SELECT bool_and(mixed LIKE '%-1') FROM names) THEN split_part(mixed, '-', 1) ELSE mixed END AS mixed FROM names",
            "names AS (SELECT c_custkey, c_name || '-1' AS common, c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN '-2' ELSE '-1' END AS mixed FROM customer)"),
        "extract_fields": (
            "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS swapped,"
            " split_part(p_brand, '#', 2) AS brand_no, CAST(NULL AS VARCHAR) AS absent FROM part"),
        "zero_pad_names": (
            "SELECT p_partkey, 'gene_' || lpad(CAST(p_partkey + 1 AS VARCHAR), CAST(floor(log10(n)) + 1 AS INTEGER), '0') AS gene_id"
            " FROM part, (SELECT count(*) AS n FROM part)"),
        "wide_to_long_unpivot": (
            "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, measure, round(value, 6) AS value FROM"
            " (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
            " UNPIVOT (value FOR measure IN (l_quantity, l_extendedprice, l_discount, l_tax)) WHERE value <> 0"),
    }
    return q
