"""Scalar text as Python values, for kernels: the default schema of treeblock.functions.scalars."""

from __future__ import annotations

import re

from treeblock.functions import scalars as S

_INT = [(re.compile(p), base) for p, base in ((S.BINARY, 2), (S.HEX, 16), (S.OCTAL, 8), (S.DECIMAL, 10))]
_SIXTY, _FLOAT, _FLOAT60, _INF, _NAN = map(re.compile, (S.BASE60, S.FLOAT, S.FLOAT_60, S.INFINITY, S.NAN))


def number(text: str):
    """None, bool, int, float or, for what is none of these, the text."""
    if text in S.NULLS:
        return None
    for pattern, base in _INT:
        if pattern.match(text):
            return int(re.sub("_|0[bx]" if base in (2, 16) else "_", "", text), base)
    sign = -1 if text.startswith("-") else 1
    if _SIXTY.match(text):
        out = 0
        for x in text.lstrip("+-").replace("_", "").split(":"):
            out = out * 60 + int(x)
        return sign * out
    if text in S.TRUE:
        return True
    if text in S.FALSE:
        return False
    if _FLOAT.match(text):
        return float(text.replace("_", ""))
    if _INF.match(text):
        return sign * float("inf")
    if _NAN.match(text):
        return float("nan")
    if _FLOAT60.match(text):
        out = 0.0
        for x in text.lstrip("+-").replace("_", "").split(":"):
            out = out * 60 + float(x)
        return sign * out
    return text


def element(text: str | None, style: str | None, datatype):
    """An inline element as its type: null is zero, booleans are true for true, True and 1."""
    if isinstance(datatype, tuple):
        return text or ""
    found = None if text is None else number(text) if style == "plain" else text
    if datatype == "bool8":
        return text in ("true", "True", "1")
    if datatype.startswith("complex"):
        value = complex(text.replace("i", "j").replace("I", "j").strip("()")) if text else 0j
        return {"re": value.real, "im": value.imag}
    if found is None:
        return 0.0 if datatype.startswith("float") else 0
    if isinstance(found, str):
        raise ValueError(f"{text!r} is no {datatype}")
    return float(found) if datatype.startswith("float") else int(found)
