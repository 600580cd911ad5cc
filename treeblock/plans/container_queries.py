"""Containers made of embeddings, 100 rows a file, read back in every way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from treeblock.functions.textfn import STANDARD_PREFIX
from treeblock.plans.registry import register, table
from treeblock.sources import frames
from treeblock.sources.datasource import TreeblockSource

FILES = "SELECT DISTINCT CAST(vec_id // 100 AS VARCHAR) AS file FROM embeddings"
SIZES = "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, count(*) AS n FROM embeddings GROUP BY 1"


def packed(spark, sf, codec="", datatype="float32", byteorder="little"):
    df = table(spark, sf, "embeddings").withColumn("file", F.floor(F.col("vec_id") / 100))
    return frames.pack_rows(df, "file", "vec_id", "embedding", datatype, codec, byteorder=byteorder)


for _codec in ("none", "zlib", "bzp2", "lz4"):

    def _make(codec=_codec):
        return lambda spark, sf: frames.read_array(packed(spark, sf, "" if codec == "none" else codec), "data", "float32", 2)

    register(f"ds_roundtrip_{_codec}", "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS value FROM embeddings")(_make())


@register("ds_big_endian", "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def big_endian(spark, sf):
    return frames.read_array(packed(spark, sf, "lz4", "float64", "big"), "data", "float64", 2)


@register("ds_strides", "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, 63 - CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS value FROM embeddings")
def strides(spark, sf):
    return frames.read_array(packed(spark, sf), "data", "float32", 2, offset=63 * 4, strides=[256, -4])


@register("ds_files", f"SELECT file, '1.0.0' AS format_version, '1.6.0' AS standard_version, 1 AS block_count, CAST(NULL AS VARCHAR) AS index_rejection, CAST(NULL AS VARCHAR) AS error FROM ({FILES})")
def files(spark, sf):
    return frames.files(packed(spark, sf)).select("file", "format_version", "standard_version", "block_count", "index_rejection", "error")


@register("ds_blocks", f"SELECT file, 0 AS block_index, 'zlib' AS compression, n * 256 AS data_size, 48 AS header_size FROM ({SIZES})")
def blocks(spark, sf):
    return frames.blocks(packed(spark, sf, "zlib")).select("file", "block_index", "compression", "data_size", "header_size")


@register("ds_block_data", f"SELECT file, n * 256 AS bytes FROM ({SIZES})")
def block_data(spark, sf):
    return frames.blocks(packed(spark, sf, "lz4"), payload=True).select("file", F.octet_length("data").cast("bigint").alias("bytes"))


@register("ds_arrays", f"SELECT file, '/data' AS node_path, 'block' AS source_kind, n AS rows, CAST(64 AS BIGINT) AS columns, 'float32' AS datatype FROM ({SIZES})")
def arrays(spark, sf):
    return frames.arrays(packed(spark, sf)).select("file", "node_path", "source_kind", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("columns"), "datatype")


@register("ds_nodes", f"SELECT file, unnest(['/asdf_library/name', '/data/byteorder', '/data/datatype']) AS node_path, unnest(['treeblock', 'little', 'float32']) AS text FROM ({FILES})")
def nodes(spark, sf):
    return frames.nodes(packed(spark, sf)).where("node_path in ('/asdf_library/name', '/data/byteorder', '/data/datatype')").select("file", "node_path", "text")


@register("ds_tagged", f"SELECT file, '/data' AS node_path, '1.1.0' AS tag_version FROM ({FILES})")
def tagged(spark, sf):
    return frames.nodes(packed(spark, sf)).where("tag_name = 'core/ndarray'").select("file", "node_path", "tag_version")


@register("ds_verify", f"SELECT file, 0 AS block_index, 'valid' AS status FROM ({FILES})")
def verify(spark, sf):
    return frames.checksums(packed(spark, sf, "bzp2"))


@register("ds_verify_broken", f"SELECT file, 0 AS block_index, 'invalid' AS status FROM ({FILES})")
def verify_broken(spark, sf):
    # the last byte of the block, before the index of three lines and its four bytes of digits
    df = packed(spark, sf)
    at = F.locate("#ASDF BLOCK INDEX", F.decode("content", "ISO-8859-1")) - 2
    text = F.decode("content", "ISO-8859-1")
    broken = F.concat(F.substr(text, F.lit(1), at), F.when(F.substr(text, at + 1, F.lit(1)) == "x", "y").otherwise("x"), F.substr(text, at + 2))
    return frames.checksums(df.select("file", F.encode(broken, "ISO-8859-1").alias("content")))


@register("ds_events", f"SELECT file, type, n FROM ({FILES}), (VALUES ('format_version', 1), ('standard_version', 1), ('block_index', 1), ('tree_start', 1), ('tree_end', 1), ('block', 1), ('end', 1)) t(type, n)")
def events(spark, sf):
    return frames.events(packed(spark, sf)).where("type != 'yaml'").groupBy("file", "type").agg(F.count("*").cast("int").alias("n"))


@register("ds_recompress", "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS value FROM embeddings")
def recompress(spark, sf):
    return frames.read_array(frames.recompressed(packed(spark, sf, "zlib"), "lz4"), "data", "float32", 2)


def read_inlined(df):
    trees = frames.inlined(df)
    head = F.lit(b"#ASDF 1.0.0\n#ASDF_STANDARD 1.6.0\n")
    again = trees.select("file", F.concat(head, F.col("tree").cast("binary")).alias("content"))
    return frames.read_array(again, "data", "float32", 2)


_ROWS = "SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS value FROM embeddings"


@register("ds_inline", _ROWS)
def inline(spark, sf):
    return read_inlined(packed(spark, sf))


#: Element types with what is taken from a number of -100 to 99, or 0 to 199 for those without a sign.
_KINDS = {t: "v" for t in ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64")} | {"float16": "v / 4.0", "float32": "v / 8.0", "float64": "v / 16.0", "bool8": "v % 2", "complex64": "v / 8.0", "complex128": "v / 16.0"}


for _type, _form in _KINDS.items():
    _v = f"((vec_id * 7 + j * 13) % 200 - {0 if _type[0] in 'ub' else 100})"
    _out = f"CAST({_form.replace('v', _v)} AS {'DOUBLE' if '.' in _form else 'BIGINT'})" if _type != "bool8" else f"{_v} % 2 = 1"
    _more = ", CAST(0 AS DOUBLE) AS im" if _type.startswith("complex") else ""

    def _decoded(datatype=_type, form=_form, v=_v):
        def query(spark, sf):
            cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("vec_id") * 7 + j * 13) % 200 - (0 if datatype[0] in "ub" else 100))
            divisor = float(form.split("/")[1]) if "/" in form else None
            cells = F.transform(cells, lambda x: x / divisor if divisor else x % 2 if datatype == "bool8" else x)
            df = table(spark, sf, "embeddings").withColumn("file", F.floor(F.col("vec_id") / 100)).withColumn("cells", cells)
            out = frames.read_array(frames.pack_rows(df, "file", "vec_id", "cells", datatype, "lz4", byteorder="big"), "data", datatype, 2)
            if datatype.startswith("complex"):
                return out.select("file", "i0", "i1", F.col("value.re").cast("double").alias("value"), F.col("value.im").cast("double").alias("im"))
            return out if datatype == "bool8" else out.withColumn("value", F.col("value").cast("double" if divisor else "bigint"))

        return query

    register(f"ds_type_{_type}", f"SELECT CAST(vec_id // 100 AS VARCHAR) AS file, vec_id - (vec_id // 100) * 100 AS i0, CAST(j AS BIGINT) AS i1, {_out} AS value{_more} FROM embeddings, range(8) t(j)")(_decoded())


def shared_folder(spark, name):
    """A folder of its own that the driver and all executors mount: below the checkpoint folder, or in local mode a
    temporary one."""
    ctx = spark.sparkContext
    base = ctx.getConf().get("spark.checkpoint.dir") or ctx.getCheckpointDir()
    if base is None and not ctx.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
    base = (base or tempfile.gettempdir()).removeprefix("file://").removeprefix("file:")
    return f"{base}/{name}-{uuid.uuid4().hex}"


for _codec in ("none", "zlib", "bzp2", "lz4"):

    def _through_source(codec=_codec):
        def query(spark, sf):
            """Written and read again by the data source."""
            spark.dataSource.register(TreeblockSource)
            made = packed(spark, sf)
            blocks = frames.blocks(made, payload=True).join(frames.arrays(made).select("file", "shape"), "file", "left")
            tree = F.concat(F.lit(f"data: !<{STANDARD_PREFIX}core/ndarray-1.1.0>\n  source: 0\n  datatype: float32\n  byteorder: little\n  shape: "), F.col("shape").cast("string"), F.lit("\n"))
            parts = F.array(F.struct("data", F.lit("" if codec == "none" else codec).alias("compression")))
            folder = shared_folder(spark, "source")
            blocks.select("file", tree.alias("tree"), parts.alias("blocks")).write.format("treeblock").mode("append").option("path", folder).save()
            # with its columns named, as an empty table leaves no file to take them from
            out = spark.read.format("treeblock").schema("file string, i0 long, i1 long, value float").option("array", "data").load(folder)
            return out.withColumn("file", F.substring_index("file", "/", -1))

        return query

    register(f"ds_source_{_codec}", _ROWS)(_through_source())
