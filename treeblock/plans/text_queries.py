"""Versions, tags, paths and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.functions import textfn as X
from treeblock.plans.registry import register, table

@register(
    "txt_version",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE CAST(p_size AS BIGINT) END AS major, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN p_partkey % 7 ELSE 0 END AS minor,
    CASE WHEN p_partkey % 5 IN (0, 1) THEN p_partkey % 11 ELSE 0 END AS patch, CASE p_partkey % 5 WHEN 1 THEN 'dev' || CAST(p_partkey AS VARCHAR) END AS extra FROM part""",
)
def version(spark, sf):
    k, n = F.col("p_partkey"), lambda c: c.cast("string")
    one, two = n(F.col("p_size")), F.concat_ws(".", n(F.col("p_size")), n(k % 7))
    three = F.concat_ws(".", two, n(k % 11))
    text = F.when(k % 5 == 0, three).when(k % 5 == 1, F.concat(three, F.when(k % 2 == 0, "-dev").otherwise(".dev"), n(k))).when(k % 5 == 2, two).when(k % 5 == 3, one).otherwise("none")
    return table(spark, sf, "part").select(k.alias("k"), X.version(text).alias("v")).select("k", "v.major", "v.minor", "v.patch", "v.extra")


@register(
    "txt_version_columns",
    "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS major, p_partkey % 7 AS minor, p_partkey % 11 AS patch, lower(p_brand) AS extra FROM part",
)
def version_columns(spark, sf):
    text = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 11).cast("string"))
    v = X.version(F.concat(text, F.lit("-"), F.lower("p_brand")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), v.alias("v")).select("k", "v.major", "v.minor", "v.patch", "v.extra")


@register(
    "txt_tag",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'core/n' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'n' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'n' || CAST(p_partkey AS VARCHAR) ELSE '' END AS name,
    CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.0.' || CAST(p_partkey % 7 AS VARCHAR) END AS version, p_partkey % 4 < 2 AS is_standard, p_partkey % 4 = 2 AS is_yaml FROM part""",
)
def tag(spark, sf):
    k = F.col("p_partkey")
    name, version = F.concat(F.lit("n"), k.cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(".0."), (k % 7).cast("string"))
    standard = F.lit(X.STANDARD_PREFIX)
    text = (
        F.when(k % 4 == 0, F.concat(standard, F.lit("core/"), name, F.lit("-"), version))
        .when(k % 4 == 1, F.concat(standard, name))
        .when(k % 4 == 2, F.concat(F.lit("tag:yaml.org,2002:"), name))
        .otherwise(F.concat(F.lit("tag:elsewhere.org:"), name, F.lit("-"), version))
    )
    return table(spark, sf, "part").select(k.alias("k"), X.tag(text).alias("t")).select("k", "t.name", "t.version", "t.is_standard", "t.is_yaml")


@register("txt_tag_match", "SELECT p_partkey AS k, p_partkey % 3 <> 2 AS same FROM part")
def tag_match(spark, sf):
    full = F.concat(F.lit("tag:example.org:"), F.col("p_name"), F.lit("-1.0.0"))
    other = F.when(F.col("p_partkey") % 3 == 0, full).when(F.col("p_partkey") % 3 == 1, F.regexp_replace(full, "^tag:", "")).otherwise(F.concat(full, F.lit("1")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.tags_match(full, other).alias("same"))


@register("txt_escape", r"SELECT page_id AS k, regexp_replace(url, '([/{}\[\].&*\\])', '\\\1', 'g') AS escaped FROM pages")
def escape(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("k"), X.escape_component(F.col("url")).alias("escaped"))


@register(
    "txt_preview",
    r"""SELECT doc_id AS k, CASE WHEN length(t) > 64 THEN substr(t, 1, 64) || '...' ELSE t END AS preview
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\x00-\x1f\x7f]+|[\x00-\x1f\x7f]+$', '', 'g'), '[\x00-\x1f\x7f]+', ' ', 'g') AS t FROM documents)""",
)
def preview(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), X.preview(F.col("text")).alias("preview"))


@register("txt_width", "SELECT doc_id AS k, length(text) AS width FROM documents")
def width(spark, sf):
    text = F.concat(F.lit("\x1b[2m"), F.col("text"), F.lit("\x1b[0m"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), X.display_width(text).cast("bigint").alias("width"))


@register("txt_md5", "SELECT doc_id AS k, md5(text) AS md5 FROM documents")
def md5(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.md5(F.col("text").cast("binary")).alias("md5"))
