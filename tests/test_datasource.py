import io
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import packer as P
from tests.oracle import check, connect
from treeblock import streaming
from treeblock.__main__ import main
from treeblock.operators import ndarray
from treeblock.plans import registry
from treeblock.sources import frames, layout
from treeblock.sources.datasource import TreeblockSource


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(TreeblockSource)
    out = tmp_path_factory.mktemp("containers")
    data = np.arange(200, dtype="<f8").reshape(20, 10)
    (out / "a.tb").write_bytes(P.file(P.ndarray(0, [20, 10], "float64"), P.block(data.tobytes())))
    (out / "b.tb").write_bytes(P.file(P.ndarray("a.tb", [20, 10], "float64"), P.block(b"x", md5=b"y" * 16)))
    return out


def load(spark, path, **options):
    return spark.read.format("treeblock").options(**options).load(str(path))


def test_modes(spark, folder):
    assert load(spark, folder).count() == 2
    assert load(spark, folder, mode="blocks").count() == 2
    assert load(spark, folder, mode="nodes").where("node_path = '/data/datatype'").count() == 2
    assert {r.source_kind for r in load(spark, folder, mode="arrays").collect()} == {"block", "external"}
    assert load(spark, folder, mode="events").where("type = 'end'").count() == 2
    assert sorted(r.status for r in load(spark, folder, mode="checksums").collect()) == ["invalid", "valid"]


def test_array_with_pruned_slices(spark, folder):
    df = load(spark, folder / "a.tb", array="data", rows="3")
    assert df.rdd.getNumPartitions() == 7
    part = df.where("i0 >= 4 and i0 < 6 and i1 = 2")
    assert [(r.i0, r.i1, r.value) for r in part.orderBy("i0").collect()] == [(4, 2, 42.0), (5, 2, 52.0)]
    assert part.rdd.getNumPartitions() == 1
    tile = ndarray.tile_2d(df.drop("file"), x=1, y=1, width=2, height=2, shape=[20, 10])
    assert sorted(r.value for r in tile.collect()) == [11.0, 12.0, 21.0, 22.0]
    with pytest.raises(ndarray.OutOfBounds):
        ndarray.tile_2d(df.drop("file"), x=9, y=0, width=2, height=1, shape=[20, 10])


@pytest.fixture
def plain(spark):
    """The session with pushdown off, as Spark's default is."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def test_filters_without_pushdown(plain, folder):
    df = load(plain, folder / "a.tb", array="data", rows="3")
    part = df.where("i0 >= 4 and i0 < 6 and i1 = 2")
    assert sorted((r.i0, r.i1, r.value) for r in part.collect()) == [(4, 2, 42.0), (5, 2, 52.0)]
    assert part.rdd.getNumPartitions() == 7 and df.count() == 200
    assert load(plain, folder, mode="blocks").where("block_index = 0").count() == 2


@pytest.mark.parametrize("codec", ["none", "zlib", "bzp2", "lz4"])
def test_query_without_pushdown(plain, sf, codec):
    name = f"ds_source_{codec}"
    check(registry.queries()[name](plain, sf), connect(sf), registry.oracle_sql()[name])


@pytest.mark.parametrize("width, n", [(64, 0), (3, 101), (1, 100)])
def test_queries_of_empty_tables_and_other_widths(plain, tmp_path, width, n):
    df = plain.range(n).selectExpr("id as vec_id", f"transform(sequence(1, {width}), j -> cast(id + j / 8 as float)) as embedding")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for codec in ("none", "zlib", "bzp2", "lz4"):
        name = f"ds_source_{codec}"
        check(registry.queries()[name](plain, str(tmp_path)), duck, registry.oracle_sql()[name])


def test_external_and_layout_options(spark, folder):
    assert load(spark, folder / "b.tb", array="data").agg(F.sum("value")).first()[0] == sum(range(200))
    back = load(spark, folder / "a.tb", array="data", offset="72", strides="[80, -8]")
    assert back.where("i0 = 0 and i1 = 0").first().value == 9.0


def test_write_reads_back(spark, tmp_path):
    spark.dataSource.register(TreeblockSource)
    rows = [(f"{i}.tb", f"n: {i}", [(bytes([i] * 50), "zlib")]) for i in range(3)]
    df = spark.createDataFrame(rows, "file string, tree string, blocks array<struct<data: binary, compression: string>>")
    df.write.format("treeblock").mode("append").option("path", str(tmp_path)).save()
    assert sorted(os.listdir(tmp_path)) == ["0.tb", "1.tb", "2.tb"]
    found = frames.blocks(frames.containers(spark, str(tmp_path)), payload=True)
    assert sorted(r.data for r in found.collect()) == [bytes([i] * 50) for i in range(3)]
    assert load(spark, tmp_path, mode="nodes").where("node_path = '/asdf_library/name'").count() == 3


def test_stream_of_a_growing_block(spark, tmp_path):
    path = tmp_path / "s.tb"
    head = P.tree(P.ndarray(0, "['*', 2]", "int32")) + P.block(b"", flags=1)
    path.write_bytes(head + np.arange(5, dtype="<i4").tobytes())
    query = streaming.rows(spark, str(path)).writeStream.format("memory").queryName("grown").start()
    try:
        query.processAllAvailable()
        assert spark.table("grown").count() == 4
        with path.open("ab") as f:
            f.write(np.arange(5, 8, dtype="<i4").tobytes())
        query.processAllAvailable()
        assert sorted(r.value for r in spark.table("grown").collect()) == list(range(8))
    finally:
        query.stop()


def test_stream_in_slices(spark, tmp_path):
    path = tmp_path / "s.tb"
    path.write_bytes(P.tree(P.ndarray(0, "['*', 2]", "int32")) + P.block(b"", flags=1) + np.arange(15, dtype="<i4").tobytes())
    source = TreeblockSource({"path": str(path), "array": "data", "mode": "array", "rows": "3"})
    reader = source.streamReader(source.schema())
    assert reader.latestOffset() == {"row": 7}
    parts = reader.partitions({"row": 1}, {"row": 7})
    assert [(p.first, p.stop) for p in parts] == [(1, 4), (4, 7)]
    found = [v for p in parts for b in reader.read(p) for v in b.column(3).to_pylist()]
    assert found == list(range(2, 14)) and reader.partitions({"row": 7}, {"row": 7}) == []


def test_command_line(folder, capsys, tmp_path):
    a, b = str(folder / "a.tb"), str(folder / "b.tb")
    assert main(["info", "--blocks", a]) == 0
    out = capsys.readouterr().out
    assert "block 0 at" in out and "ndarray" in out
    assert main(["events", a]) == 0 and "tree_start" in capsys.readouterr().out
    assert main(["verify-checksums", a]) == 0 and main(["verify-checksums", b]) == 1
    for chunk in ("7", "100000"):
        assert main(["dd", "--array", "data", "--chunk", chunk, "--output", str(tmp_path / "x"), a]) == 0
        assert (tmp_path / "x").read_bytes() == np.arange(200, dtype="<f8").tobytes()
    assert main(["info", str(folder / "none")]) == 1


def test_recompression(spark, folder):
    df = frames.recompressed(frames.containers(spark, str(folder / "a.tb")), "bzp2")
    buf = df.first().content
    x = layout.scan(buf)
    assert x.blocks[0].compression == "bzp2" and np.frombuffer(layout.data_of(buf, x.blocks[0])).sum() == sum(range(200))
    assert io.BytesIO(buf).read(5) == b"#ASDF"
