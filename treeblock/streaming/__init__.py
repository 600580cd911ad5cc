"""Streams of arrays that grow at their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rows(spark: SparkSession, path: str, array: str = "data") -> DataFrame:
    """A streaming frame (file, i0, ..., value) of the streamed block's array in a container."""
    from treeblock.sources.datasource import TreeblockSource

    spark.dataSource.register(TreeblockSource)
    return spark.readStream.format("treeblock").option("mode", "array").option("array", array).load(path)
