"""Named intermediate values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column | dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: a one-element array, transformed. Without
    this an expression that reuses its parts doubles at each level. A dict is bound as a struct."""
    if isinstance(value, dict):
        value = F.struct(*[v.alias(k) for k, v in value.items()])
    return F.transform(F.array(value), lambda x: body(x))[0]
