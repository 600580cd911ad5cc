"""Block layout, index validation and checksums over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.operators import blocks as B
from treeblock.plans.registry import register, table


@register(
    "blk_layout",
    """SELECT doc_id, header_pos, header_pos + 54 AS data_pos, header_pos + 54 + n AS "end" FROM (SELECT doc_id, n, CAST(100 + coalesce(sum(n + 54) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_pos
    FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents))""",
)
def layout(spark, sf):
    return B.offsets(table(spark, sf, "documents"), "doc_id", F.octet_length("text"), start=100, width=256).select("doc_id", "header_pos", "data_pos", "end")


@register(
    "blk_index_check",
    """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unparseable' WHEN 2 THEN 'not_monotonic' WHEN 3 THEN 'count_mismatch' WHEN 4 THEN 'first_offset_mismatch' ELSE 'not_block_magic' END AS rejection FROM orders""",
)
def index_check(spark, sf):
    k = F.col("o_orderkey")
    walked = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: k * 100 + i * 60)
    m = k % 6
    index = (
        F.when(m == 1, None)
        .when(m == 2, F.reverse(walked))
        .when(m == 3, F.slice(walked, 1, 4))
        .when(m == 4, F.transform(walked, lambda x: x + 1))
        .otherwise(walked)
    )
    return table(spark, sf, "orders").select(k.alias("k"), B.index_rejection(index, walked, m != 5).alias("rejection"))


@register("blk_md5", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'valid' ELSE 'invalid' END AS status FROM documents")
def md5(spark, sf):
    # a text of null is a block without bytes, like an empty one, and doubling it would leave it as it is
    raw, m = F.coalesce("text", F.lit("")).cast("binary"), F.col("doc_id") % 3
    stored = F.when(m == 0, F.lit(B.ZERO_MD5)).when(m == 1, F.unhex(F.md5(raw))).otherwise(F.unhex(F.md5(F.concat(raw, raw, F.lit(b"x")))))
    return table(spark, sf, "documents").select("doc_id", B.checksum_status(stored, raw).alias("status"))


@register("blk_md5_lenient", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'valid' ELSE 'invalid' END AS status FROM documents")
def md5_lenient(spark, sf):
    text = F.coalesce("text", F.lit(""))
    data = text.cast("binary")
    raw = F.reverse(text).cast("binary")
    return table(spark, sf, "documents").select("doc_id", B.checksum_status(F.unhex(F.md5(data)), F.concat(raw, F.lit(b"x")), data, F.col("doc_id") % 2 == 0).alias("status"))


@register(
    "blk_header_check",
    """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'header_size' WHEN l_linenumber = 2 THEN NULL WHEN l_quantity < 10 THEN 'allocated_size' WHEN l_quantity < 20 THEN 'data_size' END AS problem FROM lineitem""",
)
def header_check(spark, sf):
    q = F.col("l_quantity")
    size = F.when(F.col("l_linenumber") == 1, 47).otherwise(48)
    flags = F.when(F.col("l_linenumber") == 2, 1).otherwise(0)
    found = B.header_problem(flags, F.lit(""), F.when(q < 10, 5).otherwise(10), F.lit(10), F.when(q < 20, 11).otherwise(10), size)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), found.alias("problem"))
