from __future__ import annotations

from treeblock.plans import registry


def test_inlined_arrays_cover_the_whole_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the least size of more than two files
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert vectors > 200
    assert registry.queries()["ds_inline"](spark, sf).select("file", "i0").distinct().count() == vectors
