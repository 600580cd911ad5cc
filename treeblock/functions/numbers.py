"""Numbers as text and back where Python's spelling is the rule: Arrow-batched UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_PART = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+]?(?:inf|nan)"
_BOTH = re.compile(rf"^\(?(?P<re>{_PART})(?P<im>[-+](?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|inf|nan)?)[ijIJ]\)?$", re.I)
_IMAGINARY = re.compile(rf"^\(?(?P<im>{_PART}|[-+]?)[ijIJ]\)?$", re.I)
_REAL = re.compile(rf"^\(?(?P<re>{_PART})\)?$", re.I)


def parse_complex(text: str | None) -> tuple[float, float] | None:
    """Parts of a complex number as text: either part may be missing, i or j in either case, parentheses or none."""
    if text is None:
        return None
    text = text.strip()
    for pattern in (_BOTH, _IMAGINARY, _REAL):
        if m := pattern.match(text):
            found = m.groupdict()
            im = found.get("im", "0")
            im = im + "1" if im in ("", "+", "-") else im
            return float(found.get("re") or 0), float(im)
    return None


@F.pandas_udf(StringType())
def float_text(x: pd.Series) -> pd.Series:
    """The shortest text that reads back, always with a point; .nan, .inf, -.inf."""
    from treeblock.sources.treetext import float_text as one

    return x.map(one, na_action="ignore") if not x.isna().any() else x.map(lambda v: ".nan" if v != v else one(v))


@F.pandas_udf(StringType())
def complex_text(re_: pd.Series, im: pd.Series) -> pd.Series:
    """A complex number as Python spells it."""
    return pd.Series([repr(complex(a, b)) for a, b in zip(re_, im, strict=True)])


@F.pandas_udf(StructType([StructField("re", DoubleType()), StructField("im", DoubleType())]))
def complex_parts(text: pd.Series) -> pd.DataFrame:
    """Parts of complex numbers as text; null where it is none."""
    return pd.DataFrame([parse_complex(t) or (None, None) for t in text], columns=["re", "im"], dtype="float64")
