"""Times over events.ts and orders.o_orderdate."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.functions import timefn as T
from treeblock.plans.registry import register, table

JD = "(epoch_us(ts) / 86400e6 + 2440587.5)"


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("ts"))


_SQL = {name: f"({JD} - {epoch!r}) * 86400.0" for name, epoch in T.SECONDS.items()} | {
    "jd": f"{JD} - 0.0",
    "mjd": f"{JD} - 2400000.5",
    "plot_date": f"{JD} - 1721424.5",
    "jyear": f"2000.0::DOUBLE + ({JD} - 2451545.0::DOUBLE) / 365.25::DOUBLE",
    "byear": f"1900.0::DOUBLE + ({JD} - 2415020.31352::DOUBLE) / 365.242198781::DOUBLE",
}
for _name, _expr in _SQL.items():

    def _make(name=_name):
        return lambda spark, sf: _events(spark, sf).select("k", T.from_julian(T.julian_of_timestamp(F.col("ts")), name).alias("value"))

    register(f"time_to_{_name}", f"SELECT event_id AS k, {_expr} AS value FROM events")(_make())

PARTS = ["year", "month", "day", "hour", "minute", "second", "nanosecond", "yday", "wday", "unix_seconds"]
_CIVIL = (
    "CAST(year({0}) AS INTEGER) AS year, CAST(month({0}) AS INTEGER) AS month, CAST(day({0}) AS INTEGER) AS day, CAST(hour({0}) AS INTEGER) AS hour, CAST(minute({0}) AS INTEGER) AS minute, "
    "CAST(second({0}) AS INTEGER) AS second, CAST(epoch_us({0}) % 1000000 * 1000 AS INTEGER) AS nanosecond, CAST(dayofyear({0}) AS INTEGER) AS yday, CAST(dayofweek({0}) AS INTEGER) AS wday, epoch_us({0}) // 1000000 AS unix_seconds"
)


def _parts(df, c):
    return df.select("k", c.alias("c")).select("k", *[F.col(f"c.{p}").alias(p) for p in PARTS])


@register("time_parse_iso", f"SELECT event_id AS k, {_CIVIL.format('ts')} FROM events")
def parse_iso(spark, sf):
    return _parts(_events(spark, sf), T.parse_datetime(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


@register("time_parse_offset", f"SELECT event_id AS k, {_CIVIL.format('(ts - INTERVAL 90 MINUTE)')} FROM events")
def parse_offset(spark, sf):
    return _parts(_events(spark, sf), T.parse_datetime(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:30'")))


@register("time_parse_yday", f"SELECT event_id AS k, {_CIVIL.format('ts')} FROM events")
def parse_yday(spark, sf):
    return _parts(_events(spark, sf), T.parse_yday(F.date_format("ts", "yyyy:DDD:HH:mm:ss.SSSSSS")))


@register("time_civil_of_unix", f"SELECT event_id AS k, {_CIVIL.format('s')} FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)")
def civil_of_unix(spark, sf):
    # a Julian date holds 40 microseconds: whole seconds come back by rounding to the nearest one
    jd = T.julian_of(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), "unix")
    c = T.julian_to_civil(jd + 0.5 / 86400.0)
    out = _parts(_events(spark, sf), c)
    return out.withColumn("nanosecond", F.lit(0))


@register("time_jd_roundtrip", "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, epoch_us(date_trunc('day', o_orderdate)) / 86400e6 + 2440587.5 AS jd FROM orders")
def jd_roundtrip(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), T.julian_of_timestamp(F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))).alias("jd"))
    c = T.julian_to_civil(F.col("jd"))
    df = df.withColumn("c", c)
    return df.select("k", "c.year", "c.month", "c.day", T.civil_to_julian(F.col("c")).alias("jd"))


@register("time_isot", "SELECT event_id AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END AS text FROM events")
def isot(spark, sf):
    df = _events(spark, sf).withColumn("c", T.parse_datetime(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return df.select("k", T.isot(F.col("c")).alias("text"))


@register(
    "time_infer",
    "SELECT event_id AS k, CASE event_id % 9 WHEN 0 THEN 'iso' WHEN 1 THEN 'iso' WHEN 2 THEN 'iso' WHEN 3 THEN 'yday' WHEN 4 THEN 'jyear' WHEN 5 THEN 'byear' WHEN 6 THEN 'fits' END AS format FROM events",
)
def infer(spark, sf):
    """Spellings of one time by event_id: dates, times, days of the year, epochs, five-digit years, and none of these."""
    k, date = F.col("k") % 9, lambda form: F.date_format("ts", form)
    forms = [date("yyyy-MM-dd"), date("yyyy-MM-dd'T'HH:mm:ss.S"), date("yyyy-MM-dd HH:mm:ss"), date("yyyy:DDD:HH:mm:ss"), date("'J'yyyy.DDD"), date("'B'yyyy.DDD"), date("'+1'yyyy-MM-dd'T'HH:mm:ss"), date("yyyy-MM"), date("D.SSS")]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k == i, form).otherwise(text)
    return _events(spark, sf).select("k", T.infer_format(text).alias("format"))


ALL = T.FORMATS + list(T.OTHER)


@register("time_standard", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{T.OTHER.get(n, n)}')" for n in ALL) + ") t(name, standard)")
def standard(spark, sf):
    return spark.createDataFrame([(n,) for n in ALL], "name string").select("name", T.standard_format(F.col("name")).alias("standard"))


EPOCHS = [("unix", "0", 1970, 1, 1), ("galexsec", "0", 1980, 1, 6), ("cxcsec", "0", 1998, 1, 1), ("tai_seconds", "0", 1958, 1, 1), ("utime", "0", 1979, 1, 1), ("mjd", "0", 1858, 11, 17), ("gps", "0", 1980, 1, 6), ("jd", "2451545.0", 2000, 1, 1), ("jyear", "J2000.0", 2000, 1, 1), ("byear", "B1950.0", 1949, 12, 31), ("plot_date", "1", 1, 1, 1), ("decimalyear", "2024.5", 2024, 7, 2), ("fits", "-0500-01-01T00:00:00", -500, 1, 1), ("iso", "2016-12-31T23:59:60", 2016, 12, 31), ("jd", "2299159.5", 1582, 10, 4), ("jd", "2299160.5", 1582, 10, 15)]
EPOCHS[10] = ("plot_date", "738000", 2021, 7, 29)


@register("time_derive", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{v}', {y}, {m}, {d})" for f, v, y, m, d in EPOCHS) + ") t(format, value, year, month, day)")
def derive(spark, sf):
    df = spark.createDataFrame([(f, v) for f, v, *_ in EPOCHS], "format string, value string")
    c = F.lit(None).cast(T.CIVIL)
    for name in {f for f, *_ in EPOCHS}:
        c = F.when(F.col("format") == name, T.derive_civil(F.col("value"), name)).otherwise(c)
    return df.withColumn("c", c).select("format", "value", "c.year", "c.month", "c.day")
