"""Readers, the store and the stream."""

import gzip

import pytest
from pyspark.sql import functions as F

import cellweave as cw
from cellweave.operators.cluster import vote
from cellweave.operators.knn import nearest
from cellweave.plans import catalogue
from cellweave.sources.delimited import split_fields
from cellweave.sources.files import numbered_lines
from cellweave.sources.tenx import read_10x_types
from cellweave.streaming.assign import assign_stream
from tests.conftest import experiment, planted_counts

MTX = "%%MatrixMarket matrix coordinate integer general\n%note\n3 4 5\n1 1 5\n3 1 2\n2 2 7\n3 4 1\n1 3 9\n"
GENES = "ENSG1\tAAA\nENSG2\tBBB\nENSG3\tAAA\n"
TYPED = "ENSG1\tAAA\tGene Expression\nENSG2\tNA\tAntibody Capture\nENSG3\tAAA\tGene Expression\n"
BARCODES = "TT-1\nCC-1\nGG-1\nAA-1\n"


def old(tmp_path, name="v2", barcodes=BARCODES):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "matrix.mtx").write_text(MTX)
    (folder / "genes.tsv").write_text(GENES)
    (folder / "barcodes.tsv").write_text(barcodes)
    return str(folder)


def test_10x_plain(spark, tmp_path):
    exp = cw.read_files(spark, old(tmp_path), format="10X")
    assert [r.symbol for r in exp.genes.orderBy("gene_idx").collect()] == ["AAA", "BBB", "AAA.1"]
    assert [r.barcode for r in exp.cells.orderBy("cell_idx").collect()] == ["TT", "CC", "GG", "AA"]
    got = {(r.gene_idx, r.cell_idx): r["count"] for r in exp.expr.collect()}
    assert got == {(0, 0): 5.0, (2, 0): 2.0, (1, 1): 7.0, (2, 3): 1.0, (0, 2): 9.0}


def test_10x_compressed_and_typed(spark, tmp_path):
    folder = tmp_path / "v3"
    folder.mkdir()
    for name, text in (("matrix.mtx.gz", MTX), ("features.tsv.gz", TYPED), ("barcodes.tsv.gz", BARCODES.replace("AA-1", "AA-2"))):
        with gzip.open(folder / name, "wt") as out:
            out.write(text)
    exp = cw.read_files(spark, str(folder))
    assert [r.symbol for r in exp.genes.orderBy("gene_idx").collect()] == ["AAA", "AAA.1"]
    assert exp.expr.where("gene_idx = 1").count() == 0
    assert exp.cells.where("barcode = 'AA-2'").count() == 1
    other = cw.read_files(spark, str(folder), feature_type="Antibody Capture")
    assert [r.symbol for r in other.genes.collect()] == ["ENSG2"]


@pytest.mark.parametrize("change, message", [
    (("matrix.mtx", MTX.replace("3 4 5", "3 4 6")), "declares 6 entries"),
    (("matrix.mtx", MTX[:-6]), "declares 5 entries"),
    (("matrix.mtx", MTX.replace("3 4 5", "3 9 5")), "declares 3 features and 9 cells"),
    (("matrix.mtx", MTX.replace("2 2 7", "2 8 7")), "outside"),
    (("matrix.mtx", MTX.replace("2 2 7", "2 x 7")), "no numbers"),
    (("matrix.mtx", "%%MatrixMarket\n"), "no size line"),
    (("genes.tsv", GENES + "ENSG4\tDDD\n"), "4 and 4"),
])
def test_10x_files_that_contradict_each_other(spark, tmp_path, change, message):
    folder = old(tmp_path)
    (tmp_path / "v2" / change[0]).write_text(change[1])
    with pytest.raises(ValueError, match=message):
        cw.read_files(spark, folder)


def test_10x_directories_with_other_features(spark, tmp_path):
    paths = [old(tmp_path, "one"), old(tmp_path, "two")]
    (tmp_path / "two" / "genes.tsv").write_text("ENSG2\tBBB\nENSG1\tAAA\nENSG3\tAAA\n")
    with pytest.raises(ValueError, match="differ"):
        cw.read_files(spark, paths)


def test_10x_all_types(spark, tmp_path):
    folder = tmp_path / "v3"
    folder.mkdir()
    for name, text in (("matrix.mtx.gz", MTX), ("features.tsv.gz", TYPED), ("barcodes.tsv.gz", BARCODES)):
        with gzip.open(folder / name, "wt") as out:
            out.write(text)
    found = read_10x_types(spark, str(folder))
    assert list(found) == ["Gene Expression", "Antibody Capture"]
    assert [found[k].expr.count() for k in found] == [4, 1] and [found[k].cells.count() for k in found] == [4, 4]
    with pytest.raises(ValueError, match="feature type"):
        cw.read_files(spark, str(folder), feature_type="Other")


def test_ragged_lines_raise(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    for text in ('"","c1","c2"\ng1,1,2\ng2,3\n', '"","c1","c2"\ng1,1,2\ng2,3,4,5\n', '"","c1","c2","c3"\ng1,1,2\n'):
        path.write_text(text)
        with pytest.raises(ValueError):
            cw.read_files(spark, str(path), format="txt")


def test_10x_directories_are_prefixed(spark, tmp_path):
    paths = [old(tmp_path, "one"), old(tmp_path, "two")]
    ids = {r[0] for r in cw.read_files(spark, paths).cells.select("cell_id").collect()}
    assert {"TT", "2_TT"} <= ids and len(ids) == 8
    named = cw.read_files(spark, {"x": paths[0], "y": paths[1]})
    assert {r[0] for r in named.cells.select("cell_id").collect()} >= {"x_TT", "y_TT"}
    assert named.expr.count() == 10


def test_10x_missing_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cw.read_files(spark, str(tmp_path / "nowhere"))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "genes.tsv").write_text(GENES)
    with pytest.raises(FileNotFoundError):
        cw.read_files(spark, str(broken))
    with pytest.raises(ValueError):
        cw.read_files(spark, str(broken), format="hdf5")


def test_delimited(spark, tmp_path):
    a, b, c, d = (tmp_path / n for n in ("a.csv", "b.csv", "c.csv", "d.csv"))
    a.write_text('"","c1","c2"\n"g,1",0,2.5\ng2,3,0\n')
    b.write_text('"","c1","c2"\n"g,1",1,1\ng2,0,0\n')
    c.write_text("1,0,2\n0,0,4\n")
    d.write_text('"","c1","c2"\nother,1,1\ng2,0,0\n')
    one = cw.read_files(spark, str(a), format="txt")
    assert {(r.gene_idx, r.cell_idx): r["count"] for r in one.expr.collect()} == {(0, 1): 2.5, (1, 0): 3.0}
    assert [r.symbol for r in one.genes.orderBy("gene_idx").collect()] == ["g,1", "g2"]
    two = cw.read_files(spark, [str(a), str(b)], format="txt")
    assert [r.cell_id for r in two.cells.orderBy("cell_idx").collect()] == ["1_c1", "1_c2", "2_c1", "2_c2"]
    bare = cw.read_files(spark, str(c), format="txt", header=False)
    assert [r.barcode for r in bare.cells.orderBy("cell_idx").collect()] == ["cell_1", "cell_2", "cell_3"]
    assert [r.gene_id for r in bare.genes.orderBy("gene_idx").collect()] == ["gene_1", "gene_2"]
    with pytest.raises(ValueError):
        cw.read_files(spark, [str(a), str(d)], format="txt")


def test_line_numbers_hold_across_blocks(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    old_size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, str(path)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old_size)
    assert len(got) == 5000 and (got.line == "line " + got.idx.astype(str)).all()


def test_store_round_trip(spark, tmp_path):
    exp = cw.normalize_counts(experiment(spark, planted_counts(30, 12)[0]))
    cw.save(exp, str(tmp_path / "kept"))
    back = cw.load(spark, str(tmp_path / "kept"))
    assert back.expr.count() == exp.expr.count() and back.steps[0][0] == "normalize_counts"
    back.register_views()
    assert spark.sql("SELECT count(DISTINCT cell_idx) FROM expr").first()[0] == 30
    with pytest.raises(FileNotFoundError):
        cw.load(spark, str(tmp_path / "none"))


def test_stream_gives_the_batch_answer(spark, tmp_path):
    pool = spark.range(60).select(F.col("id").alias("cell_idx"), F.array(F.cos("id"), F.sin("id")).alias("vec"))
    sample = pool.where("cell_idx % 2 = 0")
    labels = sample.select("cell_idx", (F.col("cell_idx") % 3).alias("label"))
    pool.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    assign_stream(stream, sample, labels, sink, str(tmp_path / "state"), k_nn=4, conf=0.3).awaitTermination()
    got = {r.cell_idx: r.cluster_id for r in spark.read.parquet(out).collect()}
    want = {r.cell_idx: r.assigned for r in vote(nearest(pool, sample, 5), labels, 0.3).collect()}
    assert got == want


def test_fields_are_split_outside_quotes_only(spark):
    lines = ['a,b,,c,', '"a,b", c ,"d"', '"x,y,z"', '', 'p"q,r"s,t', '"a ""b, c""",""""', '"",x']
    held = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    found = [r.f for r in held.orderBy("i").select(split_fields(F.col("line"), ",").alias("f")).collect()]
    assert found == [["a", "b", "", "c", ""], ["a,b", "c", "d"], ["x,y,z"], [""], ["pq,rs", "t"], ['a "b, c"', '"'], ["", "x"]]


def test_a_wide_line_is_split_in_one_pass(spark):
    wide = spark.range(2).select(F.concat(F.lit('"g,1",'), F.repeat(F.lit("7,"), 200_000)).alias("line"))
    sizes = wide.select(F.size(split_fields(F.col("line"), ",")).alias("n")).collect()
    assert [r.n for r in sizes] == [200_002, 200_002]


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    """Parts count in the order of their names, whatever their sizes; the size line is that of the first part with one."""
    folder = tmp_path / "of parts"
    texts = {
        "genes.tsv": ["G1\ta\n", "G2\tb\nG3\tc\n" * 1],
        "barcodes.tsv": ["AA-1\n", "CC-1\n" + "GG-1\n"],
        "matrix.mtx": ["%%MatrixMarket matrix coordinate integer general\n", "% sizes follow\n3 3 4\n3 3 4\n", "1 1 5\n2 1 6\n" + " " * 500 + "1 2 7\n"],
    }
    for name, pieces in texts.items():
        (folder / name).mkdir(parents=True)
        for i, piece in enumerate(pieces):
            (folder / name / f"part-{i:05d}.txt").write_text(piece)
    exp = read_10x_types(spark, str(folder))["Gene Expression"]
    assert sorted((r.cell_idx, r.gene_idx, r["count"]) for r in exp.expr.collect()) == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 7.0), (2, 2, 4.0)]
    assert [r.cell_id for r in exp.cells.orderBy("cell_idx").collect()] == ["AA", "CC", "GG"]


def test_written_lines_are_sorted_by_many_tasks(spark, tmp_path):
    lines = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("a")).withColumn("line", F.concat(F.lit("line "), "a"))
    path = str(tmp_path / "lines")
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalogue.written_lines(lines, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1
    assert numbered_lines(spark, path).where(F.concat(F.lit("line "), "idx") != F.col("line")).count() == 0
    assert numbered_lines(spark, path).count() == 20_000


def test_stream_over_a_folder_of_parts(spark, tmp_path):
    """The vectors table may be one file or a folder of files."""
    rows = spark.range(300).select(
        F.col("id").alias("vec_id"), F.array((F.col("id") % 3).cast("float"), F.lit(1.0).cast("float"), (F.col("id") / 300).cast("float")).alias("embedding"),
        (F.col("id") % 3).cast("int").alias("label"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "embeddings.parquet"))
    rows.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    found = [
        sorted(map(tuple, catalogue.stream_assignment(spark, str(at)).collect())) for at in (tmp_path / "parts", tmp_path)
    ]
    assert len(found[0]) == 300 and found[0] == found[1]
