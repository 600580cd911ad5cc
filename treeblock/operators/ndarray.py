"""N-d arrays as frames of elements (i0, i1, ..., value), and the algebra of shapes and strides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an element (fixed values).
SIZES = {"int8": 1, "uint8": 1, "bool8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8, "complex64": 8, "complex128": 16}
MAX_U64 = "18446744073709551615"


class OutOfBounds(ValueError):
    """A tile or an element lies outside of its array."""


def elements(df: DataFrame, row: str | Column, column: str) -> DataFrame:
    """A 2-d array whose rows are an array column: row gives i0, places in the column i1."""
    row = F.col(row) if isinstance(row, str) else row
    return df.select(row.cast("bigint").alias("i0"), F.posexplode(column).alias("i1", "value")).withColumn("i1", F.col("i1").cast("bigint"))


def axes(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c[0] == "i" and c[1:].isdigit()]


def flat_index(index: list[Column], shape: list[int]) -> Column:
    """Row-major place of an index; null out of bounds."""
    flat = reduce(lambda acc, x: acc * F.lit(x[1]) + x[0], zip(index, shape, strict=True), F.lit(0).cast("bigint"))
    inside = reduce(lambda a, x: a & (x[0] >= 0) & (x[0] < x[1]), zip(index, shape, strict=True), F.lit(True))
    return F.when(inside, flat)


def box_fits(origin: list[Column], size: list[int], shape: list[int]) -> Column:
    """Whether a box lies within a shape."""
    return reduce(lambda a, b: a & b, [(o >= 0) & F.lit(s >= 0) & (o + s <= n) for o, s, n in zip(origin, size, shape, strict=True)])


def tile(frame: DataFrame, origin: list[int], size: list[int], shape: list[int] | None = None) -> DataFrame:
    """The elements of a box, with their indices counted from its origin. A size of 0 gives no rows. With a shape, a box
    that leaves it raises OutOfBounds. The ranges are predicates on index columns, which sources push down."""
    names = axes(frame)
    if not names or not len(origin) == len(size) == len(names):
        raise ValueError(f"an array of {len(names)} axes has no box of {len(origin)} by {len(size)}")
    if shape is not None and any(o < 0 or s < 0 or o + s > n for o, s, n in zip(origin, size, shape, strict=True)):
        raise OutOfBounds(f"{origin} + {size} leaves {shape}")
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= o) & (F.col(c) < o + s) for c, o, s in zip(names, origin, size, strict=True)])
    moved = [(F.col(c) - F.lit(o)).cast("bigint").alias(c) for c, o in zip(names, origin, strict=True)]
    return frame.where(inside).select(*[c for c in frame.columns if c not in names and c != "value"], *moved, "value")


def tile_2d(frame: DataFrame, x: int, y: int, width: int, height: int, planes: list[int] | None = None, shape: list[int] | None = None) -> DataFrame:
    """A box of the last two axes (x runs along the last one); planes fix the axes before, 0 by default."""
    n = len(axes(frame))
    if n < 2:
        raise ValueError("a 2-d tile needs two axes")
    planes = planes or [0] * (n - 2)
    return tile(frame, [*planes, y, x], [*[1] * (n - 2), height, width], shape)


def element(frame: DataFrame, index: list[int]) -> DataFrame:
    """The row of one element."""
    return frame.where(reduce(lambda a, b: a & b, [F.col(c) == i for c, i in zip(axes(frame), index, strict=True)])).select("value")


def flattened(frame: DataFrame, shape: list[int]) -> DataFrame:
    return frame.select(flat_index([F.col(c) for c in axes(frame)], shape).alias("flat"), "value")


def strided(flat: DataFrame, shape: list[int], strides: list[int], offset: int = 0) -> DataFrame:
    """A view of a flat array (flat, value): element (i0, ...) is the one at offset + sum(i * stride), in elements.

    Indices are generated in parallel and meet the elements by an equi-join, so that overlapping strides repeat an
    element and a stride of 0 its row. A place that the flat array lacks raises an error.
    """
    if len(shape) != len(strides):
        raise ValueError("a stride for every axis is needed")
    total = reduce(lambda a, b: a * b, shape, 1)
    names = [f"i{k}" for k in range(len(shape))]
    step = c_strides_of(shape)
    index = [F.pmod(F.floor(F.col("id") / F.lit(s)), F.lit(n)).cast("bigint") for s, n in zip(step, shape, strict=True)]
    rows = flat.sparkSession.range(total).select(*[i.alias(c) for i, c in zip(index, names, strict=True)])
    at = reduce(lambda a, x: a + F.col(x[0]) * F.lit(x[1]), zip(names, strides, strict=True), F.lit(offset).cast("bigint"))
    out = rows.withColumn("_at", at).join(flat.select(F.col("flat").alias("_at"), F.struct("value").alias("_v")), "_at", "left")
    return out.select(*names, F.when(F.col("_v").isNull(), F.raise_error(F.lit("the view leaves its data"))).otherwise(F.col("_v.value")).alias("value"))


def c_strides_of(shape: list[int]) -> list[int]:
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= max(n, 1)
    return out[::-1]


def transposed(frame: DataFrame, order: list[int] | None = None) -> DataFrame:
    """Axes in another order, reversed by default."""
    names = axes(frame)
    order = order or list(range(len(names)))[::-1]
    return frame.select(*[F.col(names[o]).alias(f"i{k}") for k, o in enumerate(order)], "value")


def nested(frame: DataFrame) -> DataFrame:
    """The last axis made arrays of values, in the order of their indices; repeated for further axes as asked."""
    *outer, last = axes(frame)
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(last, "value"))), lambda x: x["value"])
    return (frame.groupBy(*outer) if outer else frame.groupBy()).agg(gathered.alias("value"))


# shapes, as columns: array<bigint> of an array's axes


def count(shape: Column) -> Column:
    """Elements of a shape, as decimal(38,0), no more than the largest 64-bit number; 0 without axes."""
    top = F.lit(MAX_U64).cast("decimal(38,0)")
    # a product of two 64-bit factors has at most 39 digits: capped by division before it is made
    step = lambda a, x: F.when((x == 0) | (a == 0), F.lit(0).cast("decimal(38,0)")).when(a > F.floor(top / x.cast("decimal(20,0)")).cast("decimal(38,0)"), top).otherwise((a * F.greatest(x, F.lit(1)).cast("decimal(18,0)")).cast("decimal(38,0)"))
    return F.when(F.size(shape) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.aggregate(shape, F.lit(1).cast("decimal(38,0)"), step))


def nbytes(shape: Column, item: Column) -> Column:
    return count(F.concat(shape, F.array(item.cast("bigint"))))


def c_strides(shape: Column, item: Column) -> Column:
    """Bytes from one element to the next along each axis, row-major."""
    after = lambda i: F.slice(shape, i + 2, F.greatest(F.size(shape) - i - 1, F.lit(0)))
    return F.transform(shape, lambda _, i: F.aggregate(after(i), item.cast("bigint"), lambda a, x: a * x))


def extent_fits(shape: Column, strides: Column, offset: Column, item: Column, length: Column) -> Column:
    """Whether all bytes of a strided array lie within length; negative strides reach back from the offset. Empty
    arrays fit anywhere."""
    reach = F.zip_with(shape, strides, lambda n, s: (n - 1) * s)
    zero = F.lit(0).cast("bigint")
    low = F.aggregate(F.filter(reach, lambda r: r < 0), zero, lambda a, x: a + x)
    high = F.aggregate(F.filter(reach, lambda r: r > 0), zero, lambda a, x: a + x)
    return F.exists(shape, lambda n: n == 0) | ((offset + low >= 0) & (offset + high + item <= length))


def is_contiguous(shape: Column, strides: Column, item: Column) -> Column:
    """Whether strides are row-major ones; axes of length 1 do not count."""
    return F.forall(F.arrays_zip(shape.alias("n"), strides.alias("s"), c_strides(shape, item).alias("c")), lambda z: (z["n"] == 1) | (z["s"] == z["c"]))


def star_shape(rest: Column, item: Column, length: Column) -> Column:
    """The shape of a streamed array whose first axis takes what its bytes hold: whole rows only. Null for rows of no
    width."""
    row = F.aggregate(rest, item.cast("bigint"), lambda a, x: a * x)
    return F.when(row > 0, F.concat(F.array(F.floor(length / row).cast("bigint")), rest))


def inferred_datatype(value: Column) -> Column:
    """Aggregate: the narrowest type of integers; an array of zeros only is bool8, as is one of booleans."""
    lo, hi = F.min(value), F.max(value)
    return (
        F.when((lo == 0) & (hi == 0), "bool8")
        .when(lo < 0, F.when((lo >= -128) & (hi <= 127), "int8").when((lo >= -32768) & (hi <= 32767), "int16").when((lo >= -2147483648) & (hi <= 2147483647), "int32").otherwise("int64"))
        .otherwise(F.when(hi <= 255, "uint8").when(hi <= 65535, "uint16").when(hi <= 4294967295, "uint32").otherwise("uint64"))
    )


def masked_value(frame: DataFrame, sentinel) -> DataFrame:
    """Elements equal to the sentinel made null; a NaN sentinel is any NaN."""
    return frame.withColumn("value", F.when(~F.col("value").eqNullSafe(F.lit(sentinel)), F.col("value")))


def masked(frame: DataFrame, mask: DataFrame) -> DataFrame:
    """Elements made null where the mask (same axes, value boolean or number) is not false or 0; what the mask lacks stays."""
    names = axes(frame)
    flags = mask.select(*names, F.col("value").cast("boolean").alias("_m"))
    return frame.join(flags, names, "left").select(*[c for c in frame.columns if c != "value"], F.when(~F.coalesce("_m", F.lit(False)), F.col("value")).alias("value"))
