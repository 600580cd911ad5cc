"""Typed values of untyped scalar text, as column expressions.

Two schemas: "default" tries null, integer, boolean, float; "yaml11" tries null, boolean, float, integer by the YAML 1.1
type repository's grammars. What matches nothing is a string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeblock.functions.binding import let

#: Fixed spellings.
NULLS = ["", "~", "null", "Null", "NULL"]
TRUE = ["true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"]
FALSE = ["false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"]
#: Grammars (fixed patterns). Integers:
BINARY = r"^[-+]?0b[01_]*[01][01_]*$"
HEX = r"^[-+]?0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*$"
OCTAL = r"^[-+]?0[0-7_]+$"
DECIMAL = r"^[-+]?(0|[1-9][0-9_]*)$"
BASE60 = r"^[-+]?[1-9][0-9_]*(:[0-5]?[0-9])+$"
#: Floats of the default schema; the last is for text tagged as a float.
FLOAT = r"^[-+]?([0-9][0-9_]*\.[0-9_]*([eE][-+]?[0-9]+)?|\.[0-9][0-9_]*([eE][-+]?[0-9]+)?|[0-9][0-9_]*[eE][-+]?[0-9]+)$"
FLOAT_OR_INT = r"^[-+]?([0-9][0-9_]*(\.[0-9_]*)?|\.[0-9][0-9_]*)([eE][-+]?[0-9]+)?$"
#: Floats of YAML 1.1: the point is required, and the exponent's sign.
FLOAT_11 = r"^([-+]?[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)([eE][-+][0-9]+)?$"
FLOAT_60 = r"^[-+]?[0-9][0-9_]*(:[0-5]?[0-9])+\.[0-9_]*$"
INFINITY = r"^[-+]?\.(inf|Inf|INF)$"
NAN = r"^\.(nan|NaN|NAN)$"
OCTAL_12 = r"^[-+]?0o[0-7_]+$"
DATE_START = r"^[0-9_]{4}-"

MAX_UINT = "18446744073709551615"
RESULT = "struct<type:string,i:decimal(20,0),d:double,b:boolean,s:string>"


def magnitude(text: Column) -> Column:
    """Of text in an integer grammar, as decimal(38,0); null where it surely exceeds 64 bits."""
    digits = F.ltrim(F.regexp_replace(text, r"^[-+]?(0[bx])?|_", ""), F.lit("0"))
    wide = lambda x: x.cast("decimal(38,0)")
    top = wide(F.lit("1000000000000000000000"))

    def radix(digits: Column, base: int, low: int, most: int) -> Column:
        # in two parts: conv() takes no more than 64 bits
        head = F.when(F.length(digits) > low, F.substr(digits, F.lit(1), F.length(digits) - low)).otherwise("0")
        value = lambda x: F.conv(x, base, 10).cast("decimal(18,0)")
        whole = value(head) * F.lit(base**low).cast("decimal(18,0)") + value(F.right(digits, F.lit(low)))
        return F.when(F.length(digits) <= most, wide(whole))

    parts = F.split(F.regexp_replace(text, "[-+_]", ""), ":")
    part = lambda x: F.when(F.length(x) <= 20, x).otherwise("99999999999999999999").cast("decimal(20,0)")
    sixty = F.aggregate(F.when(text.rlike(BASE60), parts).otherwise(F.array(F.lit("0"))), wide(F.lit(0)), lambda acc, x: F.least(wide(acc * F.lit(60).cast("decimal(2,0)") + part(x)), top))
    body = lambda d: (
        F.when(text.rlike(BINARY), radix(d, 2, 32, 64))
        .when(text.rlike(HEX), radix(d, 16, 8, 16))
        .when(text.rlike(OCTAL), radix(d, 8, 11, 22))
        .when(text.rlike(BASE60), sixty)
        .otherwise(F.when(F.length(d) <= 20, wide(F.when(d.rlike("^[0-9]+$"), d))))
    )
    return let(F.when(digits == "", "0").otherwise(digits), body)


def is_integer(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in (BINARY, HEX, OCTAL, DECIMAL, BASE60)))


def narrowed(value: Column, negative: Column | None = None) -> Column:
    """Name of the narrowest type of an integer: unsigned for those without a sign, signed for negative ones."""
    negative = value < 0 if negative is None else negative
    signed = F.when(value >= -128, "int8").when(value >= -32768, "int16").when(value >= -2147483648, "int32").otherwise("int64")
    unsigned = F.when(value <= 255, "uint8").when(value <= 65535, "uint16").when(value <= 4294967295, "uint32").otherwise("uint64")
    return F.when(negative, signed).otherwise(unsigned)


def _result(type_: Column, i=None, d=None, b=None, s=None) -> Column:
    null = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
    return F.struct(type_.alias("type"), null(i, "decimal(20,0)").alias("i"), null(d, "double").alias("d"), null(b, "boolean").alias("b"), null(s, "string").alias("s"))


def _integer(text: Column, minus_zero: str) -> Column:
    """minus_zero: the type of -0."""
    negative = text.startswith("-")
    limit = F.when(negative, F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(F.lit(MAX_UINT).cast("decimal(20,0)"))

    def body(m: Column) -> Column:
        return F.when(m <= limit, let(F.when(negative, -m).otherwise(m), valued)).otherwise(_result(F.lit("unknown")))

    def valued(value: Column) -> Column:
        return _result(F.when(negative & (value == 0), minus_zero).otherwise(narrowed(value, negative)), i=value)

    return let(magnitude(text), body)


def _float(text: Column, pattern: str) -> Column:
    """Value of text in a float grammar, else null."""
    clean = F.regexp_replace(text, "_", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    parts = F.transform(F.split(F.regexp_replace(clean, "^[-+]", ""), ":"), lambda x: x.try_cast("double"))
    sixty = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return (
        F.when(text.rlike(pattern), clean.try_cast("double"))
        .when(text.rlike(INFINITY), sign * F.lit(float("inf")))
        .when(text.rlike(NAN), F.lit(float("nan")))
        .when(text.rlike(FLOAT_60), sign * sixty)
    )


def resolve(text: Column, schema: str = "default", style: Column | None = None) -> Column:
    """RESULT of a scalar's text. Text in quotes or blocks (style other than plain) is a string; a null text is a null
    of type null; an integer that no 64-bit type holds is of type unknown."""
    string = _result(F.lit("string"), s=text)
    boolean = _result(F.lit("bool"), b=text.isin(TRUE))
    is_bool = text.isin(TRUE + FALSE)
    number = _float(text, FLOAT if schema == "default" else FLOAT_11)
    is_float = text.rlike("|".join(f"(?:{p})" for p in (FLOAT if schema == "default" else FLOAT_11, INFINITY, NAN, FLOAT_60)))
    double = _result(F.lit("double"), d=number)
    out = F.when(text.isNull() | text.isin(NULLS), _result(F.lit("null")))
    if schema == "default":
        out = out.when(is_integer(text), _integer(text, "int8")).when(is_bool, boolean).when(is_float, double)
    elif schema == "yaml11":
        out = out.when(is_bool, boolean).when(is_float, double).when(is_integer(text), _integer(text, "uint8"))
    else:
        raise ValueError(f"unknown schema {schema!r}")
    out = out.otherwise(string)
    return out if style is None else F.when(style != "plain", string).otherwise(out)


def resolve_tagged(text: Column, tag: Column, schema: str = "default") -> Column:
    """RESULT of text with a tag null, bool, int, float or str, whatever its form; text that the tag does not fit is a
    string. Other tags give null."""
    string = _result(F.lit("string"), s=text)
    true, false = (TRUE + ["1"], FALSE + ["0"]) if schema == "default" else (TRUE, FALSE)
    number = _float(text, FLOAT_OR_INT)
    return (
        F.when(tag == "null", F.when(text.isin(NULLS), _result(F.lit("null"))).otherwise(string))
        .when(tag == "bool", F.when(text.isin(true + false), _result(F.lit("bool"), b=text.isin(true))).otherwise(string))
        .when(tag == "int", F.when(is_integer(text), _integer(text, "int8")).otherwise(string))
        .when(tag == "float", F.when(number.isNotNull(), _result(F.lit("double"), d=number)).otherwise(string))
        .when(tag == "str", string)
    )


def is_ambiguous(text: Column) -> Column:
    """Whether a string would read back as something else if it were written plain."""
    words = NULLS + TRUE + FALSE + ["<<", "=", "y", "Y", "n", "N"]
    return text.isin(words) | is_integer(text) | _float(text, FLOAT_OR_INT).isNotNull() | text.rlike(OCTAL_12) | text.rlike(DATE_START)


def as_int64(value: Column) -> Column:
    """Of a RESULT: its integer if 64 signed bits hold it."""
    return F.when(value["i"].between(-(1 << 63), (1 << 63) - 1), value["i"].try_cast("bigint"))


def as_float64(value: Column) -> Column:
    return F.coalesce(value["d"], value["i"].cast("double"))


def as_float32(value: Column) -> Column:
    """Of a RESULT: struct(value, err) of its number as a float; a finite number that becomes infinite is reported."""
    wide = as_float64(value)
    infinite = (F.abs(wide.cast("float").cast("double")) == float("inf")) & (F.abs(wide) < float("inf"))
    return F.struct(wide.cast("float").alias("value"), F.when(wide.isNull(), "TYPE_MISMATCH").when(infinite, "OVERFLOW").otherwise("OK").alias("err"))


def as_bool(value: Column) -> Column:
    """Of a RESULT: struct(value, err) of its boolean."""
    return F.struct(value["b"].alias("value"), F.when(value["b"].isNull(), "TYPE_MISMATCH").otherwise("OK").alias("err"))


def as_integer(value: Column, name: str) -> Column:
    """Of a RESULT: struct(value, err) for an integer type; a value out of range is wrapped and reported."""
    from .convert import LIMITS

    lo, hi = LIMITS[name]
    wide = F.lit(str(hi - lo + 1)).cast("decimal(21,0)")
    return let(value, lambda v: _wrapped(v["type"], v["i"].cast("decimal(38,0)"), lo, hi, wide))


def _wrapped(kind: Column, i: Column, lo: int, hi: int, wide: Column) -> Column:
    wrapped = F.pmod(i - F.lit(str(lo)).cast("decimal(20,0)"), wide) + F.lit(str(lo)).cast("decimal(20,0)")
    fits = i.between(F.lit(str(lo)).cast("decimal(20,0)"), F.lit(str(hi)).cast("decimal(20,0)"))
    err = F.when(kind == "unknown", "OVERFLOW").when(i.isNull(), "TYPE_MISMATCH").when(fits, "OK").otherwise("OVERFLOW")
    return F.struct(wrapped.cast("decimal(20,0)").alias("value"), err.alias("err"))
