import math

import pytest
from pyspark.sql import functions as F

from treeblock.functions import convert, scalars, timefn
from treeblock.plans import scalar_queries
from treeblock.sources.scalars import number


def test_kernel_resolves_as_the_columns_do(spark, sf):
    """The executors' reader of scalars against the columns, over the spellings of scal_resolve."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(scalar_queries._spelled().alias("text"))
    for row in orders.select("text", scalars.resolve(F.col("text")).alias("r")).distinct().collect():
        found, r = number(row.text), row.r
        if r.type == "null":
            assert found is None
        elif r.type == "bool":
            assert found is r.b
        elif r.type == "double":
            assert isinstance(found, float) and found == r.d
        elif r.type == "string":
            assert found == row.text
        elif r.type != "unknown":
            assert found == int(r.i)


@pytest.mark.parametrize(
    "expr,source,target,value,overflow",
    [
        ("-5", "int", "uint8", 0, True),
        ("70000", "int", "uint16", 65535, True),
        ("-70000", "int", "int16", -32768, True),
        ("42", "int", "uint8", 42, False),
        ("2147483647", "int", "float32", 2147483648.0, False),
        ("1.7976931348623157E308D", "double", "float32", math.inf, True),
        ("double('inf')", "double", "float32", math.inf, False),
        ("3.9D", "double", "int32", 3, False),
        ("-3.9D", "double", "int32", -3, False),
        ("-0.9D", "double", "uint8", 0, False),
        ("double('inf')", "double", "int32", 2147483647, True),
        ("double('-inf')", "double", "int64", -(2**63), True),
        ("double('NaN')", "double", "int32", 0, False),
        ("1e19D", "double", "uint64", 10**19, False),
        ("2e19D", "double", "uint64", 2**64 - 1, True),
        ("9.3e18D", "double", "int64", 2**63 - 1, True),
        ("true", "boolean", "int8", 1, False),
        ("7", "int", "bool8", True, False),
        ("70000.0D", "double", "float16", math.inf, True),
    ],
)
def test_saturation(spark, expr, source, target, value, overflow):
    found = spark.range(1).select(convert.saturate(F.expr(expr), source, target).alias("r")).first().r
    assert (float(found.value) if isinstance(value, float) else int(found.value) if not isinstance(value, bool) else found.value) == value
    assert found.overflow is overflow


def test_point_and_exact(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert tuple(one(convert.point(F.lit(300), "int", "uint8"))) == (0, "CONVERSION")
    assert tuple(one(convert.point(F.lit(300), "int", "float64"))) == (300.0, "OK")
    assert tuple(one(convert.point(F.lit(1.5), "double", "int8"))) == (0, "CONVERSION")
    assert one(convert.point(F.lit(True), "boolean", "float32")).err == "CONVERSION"
    assert one(convert.exact(F.lit(7.0), "double", "uint8")) == 7
    with pytest.raises(Exception, match="does not fit"):
        one(convert.exact(F.lit(7.5), "double", "uint8"))
    with pytest.raises(Exception, match="does not fit"):
        one(convert.exact(F.lit((1 << 53) + 1).cast("bigint"), "bigint", "float64"))


def test_times(spark):
    at = lambda v, f: spark.range(1).select(timefn.derive_civil(F.lit(v), f).alias("c")).first().c
    assert at("2025-07-23 11:56:15+00:00", "iso").unix_seconds == 1753271775
    assert at("2025-07-23 11:56:15+01:00", "iso").unix_seconds == 1753271775 - 3600
    assert at("2025-07-23 11:56:15-0100", "iso").unix_seconds == 1753271775 + 3600
    c = at("2026-09-04T12:34:56.5", "isot")
    assert (c.hour, c.second, c.nanosecond) == (12, 56, 500000000)
    assert at("2000-02-29", "iso").yday == 60
    assert (at("1970-01-01", "iso").wday, at("1970-01-01", "iso").yday) == (4, 1)
    assert at("2026-13-45", "iso") is None and at("not a date", "iso") is None and at("x", "jd") is None
    assert at("2025:366:00:00:00", "yday") is None and at("2024:366:00:00:00", "yday").month == 12


def test_resolution_of_nulls_and_floats(spark):
    found = spark.range(1).select(scalars.resolve(F.lit(None).cast("string")).alias("r")).first().r
    assert found.type == "null"
