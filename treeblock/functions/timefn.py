"""Times in the formats of the time schema, as column expressions.

A civil breakdown is a struct(year, month, day, hour, minute, second, nanosecond, yday, wday, unix_seconds). Numeric
formats go through Julian dates and Meeus' algorithm: the Julian calendar before 1582-10-15, the Gregorian one from then
on. unix_seconds, yday and wday are proleptic Gregorian. Scales are labels: nothing is converted between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeblock.functions.binding import let

#: Fixed names. Formats that a file's format field may hold, and those that only base_format may, with the one they stand for.
FORMATS = ["iso", "yday", "byear", "jyear", "decimalyear", "jd", "mjd", "gps", "unix", "utime", "tai_seconds", "cxcsec", "galexsec", "unix_tai"]
OTHER = {"byear_str": "byear", "datetime": "iso", "fits": "iso", "isot": "iso", "jyear_str": "jyear", "plot_date": "iso", "ymdhms": "iso", "datetime64": "iso"}
SCALES = ["utc", "tai", "tcb", "tcg", "tdb", "tt", "ut1"]
#: Julian dates of epochs (fixed values), and days of a year.
UNIX, MJD, J2000, B1900, PLOT_DATE = 2440587.5, 2400000.5, 2451545.0, 2415020.31352, 1721424.5
JULIAN_YEAR, BESSELIAN_YEAR, DAY = 365.25, 365.242198781, 86400.0
SECONDS = {
    "unix": UNIX,
    "unix_tai": UNIX,
    "gps": 2444244.5 + 19.0 / 86400.0,
    "galexsec": 2444244.5,
    "cxcsec": 2450814.5,
    "tai_seconds": 2436204.5,
    "utime": 2443874.5,
}
TEXT = ("iso", "isot", "fits", "datetime", "datetime64", "ymdhms")
#: Forms by which a format is recognised, in order (fixed patterns, each a prefix).
SHAPES = [
    ("iso", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[^T ]|[T ][0-9]{2}:[0-9]{2}:[0-9]{2})"),
    ("byear", r"^B[0-9]"),
    ("jyear", r"^J[0-9]"),
    ("yday", r"^[0-9]{4}:[0-9]{3}:[0-9]{2}:[0-9]{2}:[0-9]{2}"),
    ("fits", r"^[-+][0-9]{5}-[0-9]{2}-[0-9]{2}($|[^T ]|[T ][0-9]{2}:[0-9]{2}:[0-9]{2})"),
]
CIVIL = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int,nanosecond:int,yday:int,wday:int,unix_seconds:bigint>"
DATETIME = r"^([-+]?)([0-9]+)(?:-([0-9]+))?(?:-([0-9]+))?(?:[T ](.*))?$"
OFFSET = r"^(.+?)([-+])([0-9]{1,2}):?([0-9]{2})?$"
CLOCK = r"^([0-9]{1,2})(?::([0-9]{1,2}))?(?::([0-9]{1,2})(?:\.([0-9]*))?)?$"


def infer_format(value: Column) -> Column:
    """The format that a value's form tells, or null."""
    out = F.when(value.rlike(SHAPES[0][1]), SHAPES[0][0])
    for name, shape in SHAPES[1:]:
        out = out.when(value.rlike(shape), name)
    return out


def standard_format(name: Column) -> Column:
    """The format field's name for a format."""
    out = F.when(name.isin(FORMATS), name)
    for other, standard in OTHER.items():
        out = out.when(name == other, standard)
    return out


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01, proleptic Gregorian: years are counted from March, so that a leap day ends its year."""
    y, m = y.cast("bigint"), m.cast("bigint")
    march = {"y": F.when(m <= 2, y - 1).otherwise(y), "m": F.when(m <= 2, m + 9).otherwise(m - 3), "d": d.cast("bigint")}
    return let(march, lambda v: v["y"] * 365 + _div(v["y"], 4) - _div(v["y"], 100) + _div(v["y"], 400) + _div(v["m"] * 153 + 2, 5) + v["d"] - 1 - 719468)


def civil_from_days(days: Column) -> Column:
    """struct(y, m, d) of days from 1970-01-01, proleptic Gregorian."""
    month = lambda v: F.when(v["mp"] < 10, v["mp"] + 3).otherwise(v["mp"] - 9)
    out = lambda v: F.struct((v["y"] + (month(v) <= 2).cast("int")).alias("y"), month(v).alias("m"), (v["doy"] - _div(v["mp"] * 153 + 2, 5) + 1).alias("d"))
    by_doy = lambda v: let({"y": v["y"], "doy": v["doy"], "mp": _div(v["doy"] * 5 + 2, 153)}, out)
    by_year = lambda v: let({"y": v["yoe"] + v["era"] * 400, "doy": v["doe"] - (v["yoe"] * 365 + _div(v["yoe"], 4) - _div(v["yoe"], 100))}, by_doy)
    of_era = lambda v: let({"era": v["era"], "doe": v["doe"], "yoe": _div(v["doe"] - _div(v["doe"], 1460) + _div(v["doe"], 36524) - _div(v["doe"], 146096), 365)}, by_year)
    in_era = lambda z: let({"era": _div(z, 146097), "doe": F.pmod(z, F.lit(146097))}, of_era)
    return let(days.cast("bigint") + 719468, in_era)


def is_leap(y: Column) -> Column:
    return ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)


def civil(y, m, d, hour, minute, second, nano) -> Column:
    def body(v: Column) -> Column:
        before = F.element_at(F.array(*[F.lit(x) for x in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)]), v["month"])
        yday = v["day"] + before + (is_leap(v["year"]) & (v["month"] > 2)).cast("int")
        days = days_from_civil(v["year"], v["month"], v["day"])
        unix = days * 86400 + v["hour"].cast("bigint") * 3600 + v["minute"] * 60 + v["second"]
        wday = F.pmod(days + 4, F.lit(7)).cast("int")
        return F.struct(*[v[k].alias(k) for k in names], yday.alias("yday"), wday.alias("wday"), unix.alias("unix_seconds"))

    names = {"year": y, "month": m, "day": d, "hour": hour, "minute": minute, "second": second, "nanosecond": nano}
    return let({k: v.cast("int") for k, v in names.items()}, body)


def julian_to_civil(jd: Column) -> Column:
    f = lambda x: F.floor(x).cast("double")

    def split(v: Column) -> Column:
        alpha = f((v["z"] - 1867216.25) / 36524.25)
        b = F.when(v["z"] < 2299161.0, v["z"]).otherwise(v["z"] + 1.0 + alpha - f(alpha / 4.0)) + 1524.0
        return let({"b": b, "c": f((b - 122.1) / 365.25), "fraction": v["shifted"] - v["z"]}, month)

    def month(v: Column) -> Column:
        d = f(F.lit(365.25) * v["c"])
        return let({"b": v["b"], "c": v["c"], "d": d, "e": f((v["b"] - d) / 30.6001), "fraction": v["fraction"]}, parts)

    def parts(v: Column) -> Column:
        part = v["b"] - v["d"] - f(F.lit(30.6001) * v["e"]) + v["fraction"]
        m = F.when(v["e"] < 14.0, v["e"] - 1.0).otherwise(v["e"] - 13.0)
        return let({"part": part, "m": m, "c": v["c"]}, clock)

    def clock(v: Column) -> Column:
        # half away from zero; the value is never negative
        nanos = F.greatest(F.floor((v["part"] - f(v["part"])) * DAY * 1e9 + 0.5).cast("bigint"), F.lit(0))
        year = F.when(v["m"] > 2.0, v["c"] - 4716.0).otherwise(v["c"] - 4715.0)
        return let({"year": year, "month": v["m"], "day": f(v["part"]), "nanos": nanos}, whole)

    def whole(v: Column) -> Column:
        seconds = _div(v["nanos"], 1_000_000_000)
        return civil(v["year"], v["month"], v["day"], _div(seconds, 3600), F.pmod(_div(seconds, 60), F.lit(60)), F.pmod(seconds, F.lit(60)), F.pmod(v["nanos"], F.lit(1_000_000_000)))

    shifted = jd + 0.5
    return F.when(jd.isNotNull(), let({"shifted": shifted, "z": f(shifted)}, split))


def civil_to_julian(c: Column) -> Column:
    early = c["month"] <= 2
    y = F.when(early, c["year"] - 1).otherwise(c["year"]).cast("double")
    m = F.when(early, c["month"] + 12).otherwise(c["month"]).cast("double")
    gregorian = F.struct(c["year"], c["month"], c["day"]) >= F.struct(F.lit(1582), F.lit(10), F.lit(15))
    a = F.floor(y / 100.0).cast("double")
    b = F.when(gregorian, 2.0 - a + F.floor(a / 4.0).cast("double")).otherwise(0.0)
    seconds = c["hour"].cast("double") * 3600.0 + c["minute"].cast("double") * 60.0 + c["second"].cast("double") + c["nanosecond"].cast("double") / 1e9
    return F.floor((y + 4716.0) * 365.25).cast("double") + F.floor((m + 1.0) * 30.6001).cast("double") + c["day"].cast("double") + b - 1524.5 + seconds / DAY


def _number(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default)).try_cast("int")


def _nanos(digits: Column) -> Column:
    return F.rpad(F.substr(digits, F.lit(1), F.lit(9)), 9, "0").try_cast("int")


def parse_datetime(text: Column) -> Column:
    """Civil breakdown of a date, alone or with a time and an offset from UTC, which is applied; else null. A second may
    be 60; of a fraction, nine digits count."""
    take = lambda t, p, i: F.regexp_extract(t, p, i)

    def date(t: Column) -> Column:
        y = _number(take(t, DATETIME, 2), "x")
        clock = F.trim(take(t, DATETIME, 5))
        zulu = F.lower(F.right(clock, F.lit(1))) == "z"
        clock = F.when(zulu, F.rtrim(F.substr(clock, F.lit(1), F.length(clock) - 1))).otherwise(clock)
        return let(
            {
                "good": t.rlike(DATETIME),
                "y": F.when(take(t, DATETIME, 1) == "-", -y).otherwise(y),
                "m": _number(take(t, DATETIME, 3), "1"),
                "d": _number(take(t, DATETIME, 4), "1"),
                "timed": F.instr(F.translate(t, " ", "T"), "T") > 0,
                "clock": clock,
                "has": ~zulu & clock.rlike(OFFSET),
            },
            offset,
        )

    def offset(v: Column) -> Column:
        seconds = _number(take(v["clock"], OFFSET, 3), "0") * 3600 + _number(take(v["clock"], OFFSET, 4), "0") * 60
        signed = F.when(take(v["clock"], OFFSET, 2) == "-", -seconds).otherwise(seconds)
        clock = F.when(v["has"], take(v["clock"], OFFSET, 1)).otherwise(v["clock"])
        return let({**{k: v[k] for k in ("good", "y", "m", "d", "timed")}, "offset": F.when(v["has"], signed).otherwise(0), "clock": clock}, time)

    def time(v: Column) -> Column:
        parts = {k: F.when(v["timed"], _number(take(v["clock"], CLOCK, i), "0")).otherwise(0) for k, i in (("h", 1), ("mi", 2), ("s", 3))}
        nano = F.when(v["timed"], _nanos(take(v["clock"], CLOCK, 4))).otherwise(0)
        good = v["good"] & (~v["timed"] | v["clock"].rlike(CLOCK))
        return let({**{k: v[k] for k in ("y", "m", "d", "offset")}, **parts, "nano": nano, "good": good}, whole)

    def whole(v: Column) -> Column:
        good = v["good"] & v["y"].isNotNull() & v["m"].between(1, 12) & v["d"].between(1, 31) & (v["h"] <= 23) & (v["mi"] <= 59) & (v["s"] <= 60)
        own = civil(v["y"], F.when(good, v["m"]).otherwise(1), v["d"], v["h"], v["mi"], v["s"], v["nano"])
        return F.when(good, let(own, lambda c: F.when(v["offset"] == 0, c).otherwise(civil_of_unix(c["unix_seconds"] - v["offset"], v["nano"]))))

    return let(F.trim(text), date)


def civil_of_unix(seconds: Column, nano: Column) -> Column:
    """Civil breakdown of an instant, proleptic Gregorian."""
    body = lambda v: let(civil_from_days(v["days"]), lambda c: civil(c["y"], c["m"], c["d"], _div(v["rest"], 3600), _div(F.pmod(v["rest"], F.lit(3600)), 60), F.pmod(v["rest"], F.lit(60)), v["nano"]))
    return let({"days": _div(seconds, 86400), "rest": F.pmod(seconds, F.lit(86400)), "nano": nano}, body)


def parse_yday(text: Column) -> Column:
    """Civil breakdown of year:day[:hour[:minute[:second]]], else null."""
    pattern = r"^([0-9]+):([0-9]+)(?::([0-9]+))?(?::([0-9]+))?(?::([0-9]+)(?:\.([0-9]*))?)?$"
    names = ["y", "day", "h", "mi", "s"]

    def parts(t: Column) -> Column:
        at = {k: _number(F.regexp_extract(t, pattern, i + 1), "0") for i, k in enumerate(names)}
        return let({**at, "nano": _nanos(F.regexp_extract(t, pattern, 6)), "good": t.rlike(pattern)}, whole)

    def whole(v: Column) -> Column:
        good = v["good"] & (v["day"] >= 1) & (v["day"] <= F.when(is_leap(v["y"]), 366).otherwise(365))
        days = days_from_civil(v["y"], F.lit(1), F.lit(1)) + v["day"] - 1
        return F.when(good, let(civil_from_days(days), lambda c: civil(c["y"], c["m"], c["d"], v["h"], v["mi"], v["s"], v["nano"])))

    return let(F.trim(text), parts)


def julian_of(value: Column, name: str) -> Column:
    """Julian date of a numeric format's value."""
    if name in SECONDS:
        return F.lit(SECONDS[name]) + value / DAY
    if name in ("jyear", "jyear_str"):
        return F.lit(J2000) + F.lit(JULIAN_YEAR) * (value - 2000.0)
    if name in ("byear", "byear_str"):
        return F.lit(B1900) + F.lit(BESSELIAN_YEAR) * (value - 1900.0)
    if name == "decimalyear":
        whole = F.floor(value)
        return F.lit(UNIX) + days_from_civil(whole, F.lit(1), F.lit(1)).cast("double") + (value - whole) * F.when(is_leap(whole), 366.0).otherwise(365.0)
    return value + {"jd": 0.0, "mjd": MJD, "plot_date": PLOT_DATE}[name]


def derive_civil(value: Column, name: str) -> Column:
    """Civil breakdown of a value's text in a format; null where it cannot be read."""
    if name in TEXT:
        return parse_datetime(value)
    if name == "yday":
        return parse_yday(value)
    text = F.trim(value)
    if name in ("jyear", "byear", "jyear_str", "byear_str"):
        text = F.regexp_replace(text, "^[BJ]", "")
    number = text.try_cast("double")
    return let(number, lambda x: julian_to_civil(julian_of(x, name)))


def from_julian(jd: Column, name: str) -> Column:
    """The value in a numeric format of a Julian date."""
    if name in SECONDS:
        return (jd - F.lit(SECONDS[name])) * DAY
    if name == "jyear":
        return 2000.0 + (jd - J2000) / JULIAN_YEAR
    if name == "byear":
        return 1900.0 + (jd - B1900) / BESSELIAN_YEAR
    return jd - {"jd": 0.0, "mjd": MJD, "plot_date": PLOT_DATE}[name]


def julian_of_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 86400e6 + UNIX


def isot(c: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS[.fraction], the fraction without zeros at its end."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.when(c["year"] < 0, F.concat(F.lit("-"), F.lpad((-c["year"]).cast("string"), 4, "0"))).otherwise(F.when(c["year"] > 9999, c["year"].cast("string")).otherwise(F.lpad(c["year"].cast("string"), 4, "0")))
    fraction = F.rtrim(F.lpad(c["nanosecond"].cast("string"), 9, "0"), F.lit("0"))
    tail = F.when(c["nanosecond"] > 0, F.concat(F.lit("."), fraction)).otherwise("")
    return F.concat(year, F.lit("-"), two(c["month"]), F.lit("-"), two(c["day"]), F.lit("T"), two(c["hour"]), F.lit(":"), two(c["minute"]), F.lit(":"), two(c["second"]), tail)
