"""Numbers as text over lineitem, and complex numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.functions import numbers as N
from treeblock.plans.registry import register, table

COMPLEX = [("0j", 0.0, 0.0), ("(1+2j)", 1.0, 2.0), ("(1+j)", 1.0, 1.0), ("1-I", 1.0, -1.0), ("3", 3.0, 0.0), ("-2.5e3i", 0.0, -2500.0), ("1e-3-4.5J", 0.001, -4.5), ("x", None, None), ("1+2", None, None)]
_q = lambda x: "NULL" if x is None else repr(x)


@register("num_float_text", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_extendedprice AS VARCHAR) AS text FROM lineitem")
def float_text(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), N.float_text("l_extendedprice").alias("text"))


@register("num_complex_parts", "SELECT text, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im FROM (VALUES " + ", ".join(f"('{t}', {_q(a)}, {_q(b)})" for t, a, b in COMPLEX) + ") t(text, re, im)")
def complex_parts(spark, sf):
    df = spark.createDataFrame([(t,) for t, *_ in COMPLEX], "text string")
    found = df.select("text", N.complex_parts("text").alias("c")).select("text", "c.re", "c.im")
    return found.select("text", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("re", "im")])


@register("num_complex_text", "SELECT c_custkey AS k, '(' || (c_custkey % 5 + 1) || '+' || (c_nationkey + 1) || 'j)' AS text FROM customer")
def complex_text(spark, sf):
    text = N.complex_text((F.col("c_custkey") % 5 + 1).cast("double"), (F.col("c_nationkey") + 1).cast("double"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.alias("text"))
