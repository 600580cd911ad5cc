"""Conversion between element types by three rules.

saturate: out of range becomes the nearest bound and is flagged; point: out of range or fractional is refused; exact:
as point, but the whole read fails. Results are struct(value, overflow), struct(value, err), or the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = {f"int{n}": (-(1 << (n - 1)), (1 << (n - 1)) - 1) for n in (8, 16, 32, 64)} | {f"uint{n}": (0, (1 << n) - 1) for n in (8, 16, 32, 64)}
#: Spark types that hold each element type.
SPARK = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "bool8": "boolean",
}
FLOATS = ("float", "double")


def _kind(spark_type: str) -> str:
    return "float" if spark_type in FLOATS else "bool" if spark_type == "boolean" else "int"


def _saturated_int(x: Column, source: str, target: str) -> tuple[Column, Column]:
    lo, hi = LIMITS[target]
    out = SPARK[target]
    low, high = F.lit(str(lo)).cast(out), F.lit(str(hi)).cast(out)
    if _kind(source) == "bool":
        return x.cast("int").cast(out), F.lit(False)
    if _kind(source) == "int":
        wide = x.cast("decimal(20,0)")
        under, over = wide < F.lit(str(lo)).cast("decimal(20,0)"), wide > F.lit(str(hi)).cast("decimal(20,0)")
        return F.when(under, low).when(over, high).otherwise(F.when(~under & ~over, x).cast(out)), under | over
    d = x.cast("double")
    nan = F.isnan(d)
    # in range is what the cut leaves in range; the bounds of 64-bit types have no double below them within a step of 1
    under = ~nan & ((d < F.lit(float(lo))) if target == "int64" else (d <= F.lit(float(lo - 1))))
    over = ~nan & (d >= F.lit(float(hi + 1)))
    inside = F.when(~nan & ~under & ~over, d)
    # doubles from 2^53 on are whole; below, a cast to bigint cuts
    if target == "uint64":
        small = F.when(inside < 9007199254740992.0, inside).cast("bigint").cast("decimal(38,0)")
        cut = F.coalesce(small, inside.cast("decimal(38,0)"))
    else:
        cut = inside.cast("bigint")
    return F.when(nan, F.lit(0).cast(out)).when(under, low).when(over, high).otherwise(cut.cast(out)), under | over


def saturate(x: Column, source: str, target: str) -> Column:
    """struct(value, overflow) of x, of the Spark type source, as an element type. Floats are cut towards zero, NaN
    becomes 0 without a flag; a finite float that becomes infinite is flagged. Floats have no form as bool8."""
    if target == "bool8":
        if _kind(source) == "float":
            raise ValueError("a float has no bool8 form")
        value, over = (x if _kind(source) == "bool" else x != 0), F.lit(False)
    elif target in LIMITS:
        value, over = _saturated_int(x, source, target)
    else:
        d = (x.cast("int") if _kind(source) == "bool" else x).cast("double")
        value = d.cast(SPARK[target])
        infinite = F.abs(value.cast("double")) == float("inf")
        if target == "float16":
            # from half of the last step beyond 65504 on, rounding gives infinity
            infinite = F.abs(d) >= 65520.0
            value = F.when(infinite, F.when(d > 0, float("inf")).otherwise(float("-inf")).cast("float")).otherwise(value)
        over = infinite & (F.abs(d) < float("inf"))
    return F.when(x.isNotNull(), F.struct(value.alias("value"), over.alias("overflow")))


def point(x: Column, source: str, target: str) -> Column:
    """struct(value, err): a value that is out of range or has a fraction is 0 with the error CONVERSION. Floats take
    integers but no booleans."""
    out = SPARK[target]
    if target in LIMITS:
        lo, hi = LIMITS[target]
        if _kind(source) == "float":
            d = x.cast("double")
            fits = ~F.isnan(d) & (d >= float(lo)) & (d < float(hi + 1)) & (F.abs(d) < float("inf")) & (d == F.rint(d))
            value = F.when(fits, d).cast("decimal(38,0)").cast(out)
        else:
            wide = (x.cast("int") if _kind(source) == "bool" else x).cast("decimal(20,0)")
            fits = wide.between(F.lit(str(lo)).cast("decimal(20,0)"), F.lit(str(hi)).cast("decimal(20,0)"))
            value = F.when(fits, wide).cast(out)
    else:
        fits = F.lit(_kind(source) != "bool")
        value = x.cast("double").cast(out) if _kind(source) != "bool" else F.lit(None).cast(out)
    zero = F.lit(0).cast(out)
    return F.when(x.isNotNull(), F.struct(F.coalesce(value, zero).alias("value"), F.when(fits, "OK").otherwise("CONVERSION").alias("err")))


def or_null(x: Column, source: str, target: str) -> Column:
    """The value as an element type, or null where saturate() would flag it."""
    found = saturate(x, source, target)
    return F.when(~found["overflow"], found["value"])


def exact(x: Column, source: str, target: str) -> Column:
    """The value itself; the query fails at an element that the type does not hold. An integer becomes a float only if
    the float is equal; a double becomes a float by rounding; booleans become integers, not floats."""
    if target in LIMITS:
        found = point(x, source, target)
        return F.when(found["err"] == "OK", found["value"]).when(x.isNull(), None).otherwise(F.raise_error(F.lit(f"an element does not fit {target}")).cast(SPARK[target]))
    value = x.cast("double").cast(SPARK[target])
    if _kind(source) == "int":
        same = value.cast("decimal(38,0)") == x.cast("decimal(38,0)")
        return F.when(same | x.isNull(), value).otherwise(F.raise_error(F.lit(f"an element does not fit {target}")).cast(SPARK[target]))
    if _kind(source) == "bool":
        raise ValueError(f"a boolean has no {target} form")
    return value
