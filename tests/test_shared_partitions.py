import numpy as np
from pyspark.sql import functions as F

from tests import packer as P
from treeblock.sources.datasource import Slices, TreeblockSource, shared


def test_small_files_share_partitions(spark, tmp_path):
    spark.dataSource.register(TreeblockSource)
    data = np.arange(200, dtype="<f8")
    for i in range(9):
        (tmp_path / f"{i}.tb").write_bytes(P.file(P.ndarray(0, [20, 10], "float64"), P.block((data + i).tobytes())))
    df = spark.read.format("treeblock").options(array="data").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and spark.read.format("treeblock").options(array="data", rows="10").load(str(tmp_path)).rdd.getNumPartitions() == 18
    assert df.count() == 1800 and df.agg(F.sum("value")).first()[0] == sum(range(200)) * 9 + 200 * sum(range(9))
    parts = TreeblockSource({"path": str(tmp_path), "array": "data"}).reader(None).partitions()
    assert [len(p.parts) for p in parts] == [9]
    assert shared([1, 2, 3, 4], [4, 4, 4, 9], 8) == [Slices([1, 2]), Slices([3]), Slices([4])] and shared([], [], 8) == [Slices([])]
