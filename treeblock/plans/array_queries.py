"""Arrays over the embeddings table (rows i0 = vec_id, columns i1) and others."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.functions import convert
from treeblock.operators import ndarray as A
from treeblock.plans.registry import register, table

BASE = "SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1, unnest(embedding) AS value FROM embeddings"
WIDTH = 64


def embeddings(spark, sf):
    return A.elements(table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("arr_explode_f64", f"SELECT i0, i1, CAST(value AS DOUBLE) AS value FROM ({BASE})")
def explode(spark, sf):
    return embeddings(spark, sf).withColumn("value", F.col("value").cast("double"))


@register(
    "arr_tile_2d",
    f"""SELECT i0 - 100 AS row, i1 - 8 AS col, CAST(least(greatest(trunc(v), -128), 127) AS TINYINT) AS value, trunc(v) < -128 OR trunc(v) > 127 AS overflow
    FROM (SELECT i0, i1, CAST(value AS DOUBLE) * 1000 AS v FROM ({BASE}) WHERE i0 >= 100 AND i0 < 110 AND i1 >= 8 AND i1 < 16)""",
)
def tile_2d(spark, sf):
    found = A.tile_2d(embeddings(spark, sf), x=8, y=100, width=8, height=10)
    c = convert.saturate(F.col("value").cast("double") * 1000, "double", "int8")
    return found.select(F.col("i0").alias("row"), F.col("i1").alias("col"), c["value"].alias("value"), c["overflow"].alias("overflow"))


@register("arr_tile_nd", f"SELECT i0 - 5 AS i0, i1 - 3 AS i1, value FROM ({BASE}) WHERE i0 >= 5 AND i0 < 25 AND i1 >= 3 AND i1 < 10")
def tile_nd(spark, sf):
    return A.tile(embeddings(spark, sf), [5, 3], [20, 7])


@register("arr_tile_empty", f"SELECT i0, i1, value FROM ({BASE}) WHERE false")
def tile_empty(spark, sf):
    return A.tile(embeddings(spark, sf), [5, 3], [0, 7])


@register(
    "arr_tile_oob",
    "SELECT vec_id, CASE WHEN vec_id + 10 <= (SELECT count(*) FROM embeddings) THEN 'OK' ELSE 'OUT_OF_BOUNDS' END AS status FROM embeddings",
)
def tile_oob(spark, sf):
    df = table(spark, sf, "embeddings")
    fits = A.box_fits([F.col("vec_id"), F.lit(0)], [10, WIDTH], [df.count(), WIDTH])
    return df.select("vec_id", F.when(fits, "OK").otherwise("OUT_OF_BOUNDS").alias("status"))


@register("arr_point_read", f"SELECT value FROM ({BASE}) WHERE i0 = 7 AND i1 = 5")
def point(spark, sf):
    return A.element(embeddings(spark, sf), [7, 5])


def _view(spark, sf, width, strides, offset):
    n = table(spark, sf, "embeddings").count()
    flat = A.flattened(embeddings(spark, sf), [n, WIDTH])
    return A.strided(flat, [n, width], strides, offset)


@register("arr_neg_stride", f"SELECT i0, 63 - i1 AS i1, value FROM ({BASE})")
def neg_stride(spark, sf):
    return _view(spark, sf, WIDTH, [WIDTH, -1], WIDTH - 1)


@register("arr_step", f"SELECT i0, i1 // 2 AS i1, value FROM ({BASE}) WHERE i1 % 2 = 0")
def step(spark, sf):
    return _view(spark, sf, WIDTH // 2, [WIDTH, 2], 0)


@register("arr_overlap", f"SELECT b.i0, CAST(k AS BIGINT) AS i1, b.value FROM ({BASE}) b, range(3) t(k) WHERE b.i1 = 0")
def overlap(spark, sf):
    return _view(spark, sf, 3, [WIDTH, 0], 0)


@register("arr_transpose", f"SELECT i1 AS i0, i0 AS i1, value FROM ({BASE})")
def transpose(spark, sf):
    return A.transposed(embeddings(spark, sf))


@register("arr_flat_index", f"SELECT i0 * 64 + i1 AS flat, value FROM ({BASE})")
def flat_index(spark, sf):
    return A.flattened(embeddings(spark, sf), [1 << 40, WIDTH])


@register("arr_shape_nbytes", "SELECT count(*) AS n, CAST(count(*) * 64 AS DECIMAL(38,0)) AS elements, CAST(count(*) * 64 * 4 AS DECIMAL(38,0)) AS nbytes FROM embeddings")
def shape_nbytes(spark, sf):
    shape = F.array("n", F.lit(WIDTH).cast("bigint"))
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n")).select("n", A.count(shape).alias("elements"), A.nbytes(shape, F.lit(4)).alias("nbytes"))


@register(
    "arr_strides",
    """SELECT o_orderkey, CAST(7 * 5 * 4 AS BIGINT) AS s0, CAST(5 * 4 AS BIGINT) AS s1, CAST(4 AS BIGINT) AS s2,
    (o_orderkey % 9) * 140 + (o_orderkey % 3) * 4 + 140 <= 1000 AS fits, o_orderkey % 2 = 0 OR o_orderkey % 9 = 0 AS contiguous
    FROM (SELECT o_orderkey FROM orders)""",
)
def strides(spark, sf):
    shape = F.array(F.lit(1).cast("bigint") + F.col("o_orderkey") % 9, F.lit(7).cast("bigint"), F.lit(5).cast("bigint"))
    c = A.c_strides(shape, F.lit(4))
    offset = (F.col("o_orderkey") % 3) * 4
    return table(spark, sf, "orders").select(
        "o_orderkey", c[0].alias("s0"), c[1].alias("s1"), c[2].alias("s2"), A.extent_fits(shape, c, offset, F.lit(4), F.lit(1000)).alias("fits"), A.is_contiguous(shape, F.when(F.col("o_orderkey") % 2 == 0, c).otherwise(F.array(c[0] + 4, c[1], c[2])), F.lit(4)).alias("contiguous")
    )


@register("arr_star_dim", "SELECT doc_id, n_chars // 6 AS n0, CAST(3 AS BIGINT) AS n1 FROM documents")
def star_dim(spark, sf):
    shape = A.star_shape(F.array(F.lit(3).cast("bigint")), F.lit(2), F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", shape[0].alias("n0"), shape[1].alias("n1"))


@register("arr_renest", "SELECT l_orderkey AS i0, list(l_quantity ORDER BY l_linenumber, l_quantity) AS value FROM lineitem GROUP BY 1")
def renest(spark, sf):
    frame = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i0"), F.col("l_linenumber").cast("bigint").alias("i1"), F.col("l_quantity").alias("value"))
    return A.nested(frame)


_INTS = {"lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_size"], "labels": ["quality"], "orders": ["o_custkey"], "nation": ["n_regionkey"]}


def _infer_sql():
    one = lambda t, c: f"SELECT '{c}' AS name, CASE WHEN min({c}) = 0 AND max({c}) = 0 THEN 'bool8' WHEN max({c}) <= 255 THEN 'uint8' WHEN max({c}) <= 65535 THEN 'uint16' WHEN max({c}) <= 4294967295 THEN 'uint32' ELSE 'uint64' END AS datatype FROM {t}"
    signed = "SELECT 'balance' AS name, CASE WHEN min(v) >= -128 AND max(v) <= 127 THEN 'int8' WHEN min(v) >= -32768 AND max(v) <= 32767 THEN 'int16' ELSE 'int32' END AS datatype FROM (SELECT CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer)"
    return " UNION ALL ".join([one(t, c) for t, cs in _INTS.items() for c in cs] + [signed])


@register("arr_dtype_infer", _infer_sql())
def dtype_infer(spark, sf):
    parts = []
    for t, cs in _INTS.items():
        agg = table(spark, sf, t).agg(*[A.inferred_datatype(F.col(c)).alias(c) for c in cs])
        parts.append(agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("datatype")) for c in cs])).alias("x")).select("x.*"))
    parts.append(table(spark, sf, "customer").agg(A.inferred_datatype(F.floor("c_acctbal").cast("bigint")).alias("datatype")).select(F.lit("balance").alias("name"), "datatype"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("arr_mask_value", "SELECT doc_id AS i0, CASE WHEN quality <> 0 THEN quality END AS value FROM labels")
def mask_value(spark, sf):
    return A.masked_value(table(spark, sf, "labels").select(F.col("doc_id").alias("i0"), F.col("quality").alias("value")), 0)


@register("arr_mask_array", "SELECT d.doc_id AS i0, CASE WHEN coalesce(toxic, 0) = 0 THEN n_chars END AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def mask_array(spark, sf):
    frame = table(spark, sf, "documents").select(F.col("doc_id").alias("i0"), F.col("n_chars").alias("value"))
    return A.masked(frame, table(spark, sf, "labels").select(F.col("doc_id").alias("i0"), F.col("toxic").alias("value")))


@register("arr_compound", "SELECT l_orderkey AS i0, CAST(l_linenumber AS BIGINT) AS i1, CAST(l_linenumber AS INTEGER) AS id, CAST(l_quantity AS FLOAT) AS value FROM lineitem")
def compound(spark, sf):
    record = F.struct(convert.saturate(F.col("l_linenumber"), "int", "uint16")["value"].alias("id"), F.col("l_quantity").cast("float").alias("value"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i0"), F.col("l_linenumber").cast("bigint").alias("i1"), record.alias("value"))
    return rows.select("i0", "i1", "value.id", "value.value")
