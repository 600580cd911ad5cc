"""Differences between two trees, as a full outer join of their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeblock.functions import scalars
from treeblock.functions.binding import let

KINDS = ["missing_left", "missing_right", "kind", "tag", "length", "value"]


def floats_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """NaN equals NaN; else within the tolerance times the largest of |a|, |b| and 1."""
    same = a.eqNullSafe(b)
    return same if not tolerance else same | F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * F.lit(tolerance), F.lit(False))


def scalars_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Of two resolved scalars: integers by value whatever their width, a whole float equals its integer, strings by text."""
    number = lambda x: F.coalesce(x["d"], x["i"].cast("double"))
    numeric = lambda x: x["d"].isNotNull() | x["i"].isNotNull()
    return (
        F.when(a["i"].isNotNull() & b["i"].isNotNull(), a["i"] == b["i"])
        .when(numeric(a) & numeric(b), floats_equal(number(a), number(b), tolerance))
        .otherwise((F.when(numeric(a), "number").otherwise(a["type"]) == F.when(numeric(b), "number").otherwise(b["type"])) & a["b"].eqNullSafe(b["b"]) & a["s"].eqNullSafe(b["s"]))
    )


def differences(left: DataFrame, right: DataFrame, keys: list[str] | None = None, tolerance: float = 0.0, tags: bool = False, ignore_key_order: bool = True, schema: str = "default", limit: int | None = 50) -> DataFrame:
    """Rows file, node_path, difference, left, right for nodes that differ.

    left, right: nodes frames with node_path, kind, style, text, tag and size (children). A node that one side lacks is
    reported once, not with what is below it. Different kinds, tags (if asked for) or lengths are reported instead of
    values; keys of mappings meet by name, and without ignore_key_order their order counts as a value. limit keeps that many
    differences in the order of paths; None keeps all.
    """
    keys = keys or [c for c in ("file",) if c in left.columns]
    pick = lambda d, side: d.select(*keys, "node_path", F.struct("kind", "style", "text", "tag", "size", "ord").alias(side))
    both = pick(left, "l").join(pick(right, "r"), [*keys, "node_path"], "full")
    value = lambda s: scalars.resolve(F.col(f"{s}.text"), schema, F.coalesce(F.col(f"{s}.style"), F.lit("plain")))
    shape = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("l.kind") != F.col("r.kind"), "kind")
    # equal text in equal style needs no resolution
    alike = F.col("l.text").eqNullSafe(F.col("r.text")) & F.col("l.style").eqNullSafe(F.col("r.style"))
    differ = (
        shape.when(F.lit(tags) & ~F.col("l.tag").eqNullSafe(F.col("r.tag")), "tag")
        .when((F.col("l.kind") == "sequence") & (F.col("l.size") != F.col("r.size")), "length")
        .when((F.col("l.kind") == "scalar") & ~alike & ~let({"a": value("l"), "b": value("r")}, lambda v: scalars_equal(v["a"], v["b"], tolerance)), "value")
        .when(F.lit(not ignore_key_order) & (F.col("l.ord") != F.col("r.ord")), "value")
    )
    out = both.withColumn("difference", differ).where("difference is not null")
    # what lies below a node that is missing, or of another kind, goes without saying
    top = both.where(shape.isNotNull()).select(*keys, F.col("node_path").alias("above"))
    slash = F.split("node_path", "/")
    above = both.where(shape.isNotNull()).select(*keys, "node_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(slash) - 1, F.lit(1))), lambda i: F.array_join(F.slice(slash, 1, i), "/"))).alias("above"))
    above = above.withColumn("above", F.when(F.col("above") == "", "/").otherwise(F.col("above"))).where("above != node_path")
    below = above.join(top, [*keys, "above"], "left_semi").select(*keys, "node_path").distinct()
    out = out.join(below, [*keys, "node_path"], "left_anti")
    out = out.select(*keys, "node_path", "difference", F.col("l.text").alias("left"), F.col("r.text").alias("right"))
    return out.orderBy(*keys, "node_path").limit(limit) if limit is not None else out


def equal(left: DataFrame, right: DataFrame, **options) -> bool:
    return differences(left, right, **options | {"limit": 1}).isEmpty()
