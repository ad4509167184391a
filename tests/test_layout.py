"""Layouts in blocks: grid forces, independence of the partitioning, heavy cells, several blocks."""

import numpy as np
import pytest

from cellweave.operators import embed
from cellweave.operators.layout import Block, Grid, Layout, charges, extent, field_of, numbered, repulsion


def vector_frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, x.tolist())), "cell_idx long, vec array<double>")


def groups(n=180, seed=3):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 3
    return rng.normal(size=(3, 8))[label] * 6 + rng.normal(size=(n, 8)), label


def placed(df):
    return np.stack(df.toPandas().sort_values("cell_idx")["vec"])


def apart(xy, label):
    centers = np.stack([xy[label == k].mean(axis=0) for k in range(3)])
    return (((xy[:, None] - centers) ** 2).sum(2).argmin(1) == label).mean()


@pytest.mark.parametrize("scale", [1e-4, 1.0, 25.0])
def test_grid_forces_are_within_one_percent(scale):
    at = np.random.default_rng(1).normal(size=(700, 2)) * scale
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    near = 1 / (1 + d2)
    exact = ((near**2)[:, :, None] * (at[:, None] - at[None])).sum(1)
    grid = Grid.over(at.min(axis=0), at.max(axis=0))
    read = grid.read(grid.potentials(grid.spread(at, charges(at))), at)
    assert np.linalg.norm(repulsion(at, read) - exact) < 0.01 * np.linalg.norm(exact)
    assert abs(read[:, 0].sum() / near.sum() - 1) < 0.01


def test_numbers_follow_the_ids(spark):
    ids = [9, 2, 77, -4, 30, 5, 41]
    got = numbered(vector_frame(spark, np.zeros((7, 1)), ids).repartition(4)).collect()
    assert [r.cell_idx for r in sorted(got, key=lambda r: r.idx)] == sorted(ids) and sorted(r.idx for r in got) == list(range(7))


@pytest.mark.parametrize(
    "fit, rounds, block_size, share",
    [
        (embed.fit_umap, {"n_epochs": 20}, 1000, 0.9),
        (embed.fit_umap, {"n_epochs": 20}, 64, 0.9),
        (embed.fit_tsne, {"max_iter": 150}, 1000, 0.9),
        (embed.fit_tsne, {"max_iter": 100}, 64, 0.75),
    ],
)
def test_layout_does_not_depend_on_partitions(spark, fit, rounds, block_size, share):
    """One block or several, any number of partitions: the same positions, and groups stand apart."""
    x, label = groups()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for partitions, inputs in (("2", 1), ("7", 5)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found.append(placed(fit(vector_frame(spark, x).repartition(inputs), seed=5, block_size=block_size, **rounds)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(found[0], found[1], atol=1e-6)
    assert np.isfinite(found[0]).all() and apart(found[0], label) > share


def test_field_of_blocks_is_that_of_all_cells(spark):
    at = np.random.default_rng(2).normal(size=(50, 2)) * 5
    links = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "node long, other long, weight double")
    layout = Layout(vector_frame(spark, at), links, 2, embed.tsne_pull, block_size=16)
    low, high = extent(layout)
    assert np.allclose(low, at.min(axis=0)) and np.allclose(high, at.max(axis=0))
    grid = Grid.over(low, high)
    row = field_of(layout, grid).first()
    want = grid.potentials(grid.spread(at, charges(at)))
    assert np.allclose(np.array(row.potentials).reshape(4, -1), want, atol=1e-8)
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    assert row.z == pytest.approx((1 / (1 + d2)).sum(), rel=0.01)


def test_heavy_cells_get_the_same_forces(spark):
    """A cell that all others are linked to is summed by an aggregation; the force is that of its block's own sum."""
    at = np.random.default_rng(4).normal(size=(40, 2))
    pairs = [(0, j, 0.1 + j / 40) for j in range(1, 40)]
    links = spark.createDataFrame(pairs + [(j, i, w) for i, j, w in pairs], "node long, other long, weight double")
    pull = embed.umap_pull(1.5, 0.9)

    def move(block: Block, turn, rounds, field):
        force = block.sums(pull(block.at[block.node] - block.around()[block.other], block.weight)) + block.steady[:, :-1]
        block.first, block.at = force, block.at + 0.01 * force
        block.second = np.repeat(block.sums(block.weight[:, None]) + block.steady[:, -1:], 2, axis=1)

    found = []
    for heavy in (1000, 10):
        layout = Layout(vector_frame(spark, at), links, 2, pull, block_size=15, heavy_links=heavy)
        for turn, rounds in layout.supersteps(1, 1):
            layout.advance(move, turn, rounds)
        rows = layout.state.orderBy("block").collect()
        found.append(np.concatenate([np.array([r.at, r.first, r.second]) for r in rows], axis=1))
    assert np.allclose(found[0], found[1], atol=1e-9) and np.abs(found[0][1]).max() > 0


def test_cells_without_links_and_single_cells(spark):
    x = np.zeros((1, 3))
    assert placed(embed.fit_umap(vector_frame(spark, x), n_epochs=2)).shape == (1, 2)
    copies = np.ones((30, 3))
    assert np.isfinite(placed(embed.fit_umap(vector_frame(spark, copies), n_epochs=3, block_size=8))).all()
    with pytest.raises(ValueError):
        embed.fit_tsne(vector_frame(spark, copies), components=3)


def test_placing_others_near_their_group(spark):
    x, label = groups(150)
    every, model = vector_frame(spark, x), vector_frame(spark, x[:90])
    layout = embed.fit_umap(model, n_epochs=40, seed=2)
    xy = placed(embed.place_by_neighbours(every, model, layout, n_epochs=30, seed=2))
    assert np.allclose(xy[:90], placed(layout)) and apart(xy, label) > 0.95


def test_supersteps_read_no_table_twice_for_what_is_known(spark):
    """Links of heavy cells are found once, a layout's extent comes with its superstep, forces are summed a coordinate at a time."""
    at = np.random.default_rng(6).normal(size=(40, 2))
    pairs = [(0, j, 0.1 + j / 40) for j in range(1, 40)]
    links = spark.createDataFrame(pairs + [(j, i, w) for i, j, w in pairs], "node long, other long, weight double")
    layout = Layout(vector_frame(spark, at), links, 2, embed.tsne_pull, block_size=15, heavy_links=10)
    assert "Join" not in layout.heavy_links._jdf.queryExecution().executedPlan().toString()
    def move(block: Block, turn, rounds, field):
        slow = block.sums(embed.tsne_pull(block.at[block.node] - block.around()[block.other], block.weight))
        assert (embed.tsne_sums(block) == slow).all()
        block.at += 1 + block.base

    layout.advance(move, 0, 1)
    rows = placed(layout.result())
    low, high = layout.box[:2], layout.box[2:]
    assert extent(layout) == (low, high) and low == [*rows.min(axis=0)] and high == [*rows.max(axis=0)]
