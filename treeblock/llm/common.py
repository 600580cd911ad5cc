"""What several operators share: tables, Arrow maps, folders, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema, at_once: int | None = None) -> DataFrame:
    """fn on every Arrow batch of df, or on so many rows of it at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = at_once or max(1, batch.num_rows)
            for lo in range(0, max(1, batch.num_rows), step):
                yield from fn(batch.slice(lo, step))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of Arrow batches, which hold whole texts, unless the session's bound is lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables; a local one is set only where none is named."""
    ctx = spark.sparkContext
    found = ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if not found:
        if not ctx.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        found = "/tmp/treeblock-checkpoints"
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a cut of its lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the folders that written() made for df."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    """Partitions of a shuffle: the session's setting, which grows with the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
