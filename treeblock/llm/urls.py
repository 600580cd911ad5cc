"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules whose digests are sent to all executors; more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Hex digits of the digest on which expressions and rules are joined.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query (fixed values).
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host and path of its url; other columns of those names are replaced."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url, and more) with host, path, rule, verdict.

    rules: rule string (host and path prefix, like example.net/en/), verdict string. A rule fits its host and all
    subdomains where the path starts with the rule's path. Of several that fit, the longest wins; of equally long ones
    the allowing one, then the one of least checksum. A url without a rule gets the default. Null urls and urls without ://
    have an empty host and path, which no rule fits unless its own host is empty. Null rules are left out. Every row
    stays; host, path, rule and verdict replace columns of those names.

    Each different (host, path) is expanded into the host's suffixes of whole labels times the path's prefixes of the
    lengths that rules have; these meet the rules on the first PREFIX digits of their SHA-256, and then in full.
    """
    split = rules.where("rule is not null").select("rule", "verdict", F.instr("rule", "/").alias("at"))
    head = F.when(F.col("at") > 0, F.expr("substring(rule, 1, at - 1)")).otherwise(F.col("rule"))
    tail = F.when(F.col("at") > 0, F.expr("substring(rule, at)")).otherwise(F.lit(""))
    split = split.select("rule", "verdict", F.translate(head, UPPER, LOWER).alias("h"), tail.alias("p"))
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    split = split.withColumn("full", digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("full", 1, PREFIX))
    bounds = split.agg(F.count("*"), F.collect_set(F.length("p")), F.max(F.size(F.split("h", r"\.")))).first()
    n, lengths, labels = bounds[0], sorted(bounds[1]), bounds[2] or 1
    pages = parsed(pages).drop("rule", "verdict")
    keys = pages.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(parts) - F.lit(labels - 1)), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>"), lambda x: x <= F.length("path")),
        lambda x: F.col("path").substr(F.lit(1), x),
    )
    full = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))
    probes = keys.select("host", "path", F.explode(F.array_distinct(full)).alias("probe"))
    probes = probes.withColumn("short", F.substring("probe", 1, PREFIX))
    small = split.select("rule", "verdict", "full", "short")
    if n <= BROADCAST_RULES:
        small = F.broadcast(small)
    best = (
        probes.join(small, "short")
        .where(F.col("probe") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "allow", F.negative(F.crc32("rule")))).alias("best"))
    )
    out = pages.join(best, ["host", "path"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


ORACLE = """
WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
rules AS (SELECT rule, verdict, substr(rule, 1, instr(rule, '/') - 1) AS h, substr(rule, instr(rule, '/')) AS p FROM r),
u AS (SELECT row_number() OVER () AS k, page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
m AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""
