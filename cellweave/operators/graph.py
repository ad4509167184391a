"""Neighbour graphs and modularity clustering as joins and aggregations.

Tables of nodes, links and communities grow with the graph and are joined anew in
every round, so they are joined by sorting and never sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import materialize, materialize_with

# Rounds without a rise of the modularity by so much after which a level ends.
PATIENCE = 2
LEAST_RISE = 1e-4


def graph_edges(knn: DataFrame) -> DataFrame:
    """Undirected simple graph: ``src < dst``, no loops, no repeated edges."""
    return (
        knn.where(F.col("cell_idx") != F.col("nn_cell_idx"))
        .select(F.least("cell_idx", "nn_cell_idx").alias("src"), F.greatest("cell_idx", "nn_cell_idx").alias("dst"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(n_edges, modularity)`` for labels ``(node, community)``.

    Both edge ends add to their community's degree, edges inside add to its
    inner count, so one aggregation by community is enough.
    """
    first = labels.select(F.col("node").alias("src"), F.col("community").alias("a"))
    second = labels.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    ends = edges.join(first.hint("merge"), "src").join(second.hint("merge"), "dst")
    per = (
        ends.select(F.explode(F.array(
            F.struct(F.col("a").alias("community"), (F.col("a") == F.col("b")).cast("long").alias("inner")),
            F.struct(F.col("b").alias("community"), F.lit(0).cast("long").alias("inner")),
        )).alias("e"))
        .groupBy("e.community")
        .agg(F.sum("e.inner").alias("inside"), F.count(F.lit(1)).alias("degree"))
    )
    m = F.sum("degree") / 2
    return per.agg(
        m.cast("long").alias("n_edges"),
        (F.sum("inside") / m - F.sum(F.col("degree") * F.col("degree")) / (4 * m * m)).alias("modularity"),
    )


def louvain(edges: DataFrame, seed: int = 0) -> DataFrame:
    """``(node, community)`` by modularity optimisation, communities numbered by size.

    Every sweep is one distributed round: links meet the community of their far
    end, are summed per (node, community), and each node takes its best gain. A
    seeded coin lets about half of the nodes move per round, so that two neighbours
    do not swap places for ever. A level ends when no node gains by moving or
    ``PATIENCE`` rounds did not raise the modularity by ``LEAST_RISE``; its communities become the
    nodes of the next level. When no level gains any more, the single nodes move
    once again. State is written after every round, so lineage stays short.
    """
    loops = F.struct("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))
    step = F.struct("src", "dst", F.lit(1.0).alias("w"))
    ends = both_ways(edges).select(F.explode(F.array(step, loops)).alias("l")).select("l.*")
    links = materialize(ends.groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0  # twice the edge count
    members = links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("community"))
    if not total:
        return members.withColumn("community", F.lit(1))
    single, best_q, turn = links, -1.0, seed
    while True:
        alone = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select(
            "node", "k", F.col("node").alias("community"), F.lit(turn).alias("turn")
        )
        placed, turn = _settled(links, alone, total)
        links = materialize(_contract(links, placed), "links")
        q = _quality(links, total)
        if q <= best_q + LEAST_RISE:
            break
        best_q = q
        members = materialize(
            members.join(placed.select(F.col("community").alias("upper"), F.col("node").alias("community")).hint("merge"), "community")
            .select("node", F.col("upper").alias("community")),
            "members",
        )
    degree = single.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    merged = degree.join(members.hint("merge"), "node").select("node", "k", "community", F.lit(turn).alias("turn"))
    return number_by_size(_settled(single, merged, total)[0])


def _settled(links: DataFrame, state: DataFrame, total: float) -> tuple[DataFrame, int]:
    """``(node, community)`` of the best round, and the next round's number.

    The sum of what every node holds by staying is the modularity of the round's
    input, but for a constant and the factor ``total``.
    """
    best, best_held, stale, turns = state, None, 0, 0
    while True:
        after, seen = materialize_with(
            _sweep(links, state, total),
            "state",
            held=F.sum("stay"),
            moved=F.sum(F.col("moved").cast("long")),
            turn=F.max("turn"),
        )
        if best_held is None or seen["held"] > best_held + LEAST_RISE * total:
            best, best_held, stale = state, seen["held"], 0
        else:
            stale += 1
        if not seen["moved"] or stale >= PATIENCE:
            return best.select("node", "community"), seen["turn"]
        state = after.drop("stay")


def _sweep(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """``(node, k, community, turn, moved, stay)`` after one round; ``stay`` is what the node held before.

    Every node has a loop row, which carries its own community without adding to
    its pull, so no node is lost and staying is always among the choices.
    """
    here = state.select(F.col("node").alias("src"), "k", F.col("community").alias("home"), "turn")
    volume = state.groupBy("community").agg(F.sum("k").alias("volume"))
    there = state.select(F.col("node").alias("dst"), "community").join(volume.hint("merge"), "community")
    weight = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("w"))
    pull = (
        links.join(there.hint("merge"), "dst").join(here.hint("merge"), "src")
        .groupBy("src", "k", "home", "turn", "community")
        .agg(F.sum(weight).alias("into"), F.max("volume").alias("volume"))
    )
    staying = F.col("community") == F.col("home")
    rest = F.col("volume") - F.when(staying, F.col("k")).otherwise(0.0)
    gain = F.col("into") - F.col("k") * rest / total
    choice = pull.groupBy("src", "k", "home", "turn").agg(
        F.max(F.when(~staying, F.struct(gain.alias("gain"), (-F.col("community")).alias("minus")))).alias("best"),
        F.max(F.when(staying, gain)).alias("stay"),
    )
    active = F.pmod(F.xxhash64("src", "turn"), F.lit(2)) == 0
    better = F.coalesce(F.col("best.gain") > F.col("stay") + 1e-9, F.lit(False))
    return choice.select(
        F.col("src").alias("node"), "k", (F.col("turn") + 1).alias("turn"), better.alias("moved"), "stay",
        F.when(better & active, -F.col("best.minus")).otherwise(F.col("home")).alias("community"),
    )


def _contract(links: DataFrame, placed: DataFrame) -> DataFrame:
    a = placed.select(F.col("node").alias("src"), F.col("community").alias("a"))
    b = placed.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    return (
        links.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
        .groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
        .agg(F.sum("w").alias("w"))
    )


def _quality(links: DataFrame, total: float) -> float:
    """Modularity of the communities that are the nodes of a contracted graph."""
    inside = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
    per = links.groupBy("src").agg(F.sum("w").alias("k"), inside.alias("inside"))
    inner, square = per.agg(F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return inner / total - square / total**2


def number_by_size(members: DataFrame) -> DataFrame:
    """Communities renumbered 1.. from the largest; ties by the smallest member."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first")  # one row per community
    numbered = sizes.select("community", F.row_number().over(order).alias("number"))
    return members.join(numbered.hint("merge"), "community").select("node", F.col("number").alias("community"))
