"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block.
BLOCK_ROWS = 8
#: Leading hex digits of a row's hash that number the row within its source in parts.
DIGITS = 3
COLUMNS = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]


def exact_shares(sources: list[str], weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Slots of each source of positive weight in the least period that makes all weights whole, and that period.

    Weights are the decimal numbers that they are written as; what listed ones leave of 1 is shared evenly by the
    sources that weights does not list, and all are divided by their sum."""
    given = {s: max(Fraction(0), Fraction(str(weights[s]))) for s in sources if s in weights}
    rest = [s for s in sources if s not in weights]
    left = max(Fraction(0), Fraction(1) - sum(given.values()))
    target = given | {s: left / len(rest) for s in rest}
    total = sum(target.values()) or Fraction(1)
    target = {s: w / total for s, w in target.items() if w}
    period = lcm(*[w.denominator for w in target.values()])
    return {s: int(w * period) for s, w in sorted(target.items())}, period


def schedule(share: dict[str, int], period: int, until: int | None = None) -> dict[str, list[int]]:
    """Slots of each source in a period, or in its first slots, earliest deadline first among released blocks.

    Block i of a source with p slots is released at floor(i Q / p) and due at ceil((i + 1) Q / p). The shares fill the
    period, so every block is placed between the two, and no source is ever a whole block ahead or behind.
    """
    due: list[tuple[int, str, int]] = []
    release: list[tuple[int, int, str, int]] = [(0, -(-period // p), s, 0) for s, p in share.items()]
    heapq.heapify(release)
    out: dict[str, list[int]] = {s: [] for s in share}
    for slot in range(period if until is None else min(until, period)):
        while release and release[0][0] <= slot:
            _, d, s, i = heapq.heappop(release)
            heapq.heappush(due, (d, s, i))
        _, s, i = heapq.heappop(due)
        out[s].append(slot)
        if i + 1 < share[s]:
            heapq.heappush(release, ((i + 1) * period // share[s], -(-(i + 2) * period // share[s]), s, i + 1))
    return out


def mixed(docs: DataFrame, weights: dict[str, float], block_rows: int = BLOCK_ROWS, seed: str = "") -> DataFrame:
    """docs with a place for every row in a mix of its sources: read by (mix_slot, mix_place), sources have their
    target weights, each less than a block off, for as long as they last; later slots belong to the sources left.
    Sources of no weight come after all others, a block each in turn.

    Rows of a source come in the order of a hash of doc_id and text, cut into blocks of block_rows. mix_block is the
    block's number in its source, mix_release and mix_deadline bound its slot, mix_place is the row's place in its block.
    Null sources count as one source; so do empty ones. Repeated rows each get a place of their own; which of several
    rows of equal doc_id and text comes first is left open. COLUMNS replace columns of those names; all others stay as
    they are. An empty table gives an empty result.

    The schedule's period is the least that makes all weights whole. The driver makes it while planning, up to the
    slots that the rows need, and sends it as one array.

    Rows are numbered within (source, first DIGITS digits of the hash), so that one source's rows are dealt to many
    tasks; the parts' sizes, at most 16 ** DIGITS a source, give each part its first number.
    """
    own = [c for c in docs.columns if c not in COLUMNS]
    key = F.coalesce(F.col("source").cast("string"), F.lit("\0none"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("_src"), F.md5(name.cast("binary")).alias("_hash"))
    rows = rows.withColumn("_part", F.substring("_hash", 1, DIGITS))
    counts = {r[0]: -(-r[1] // block_rows) for r in rows.groupBy("_src").agg(F.count("*")).collect()}
    share, period = exact_shares(sorted(counts), weights)
    end = max((-(-counts[s] * period // p) for s, p in share.items()), default=0)
    slots = schedule(share, period, end) if share else {}
    last = sorted(counts.keys() - share.keys())  # sources of no weight
    sizes = rows.groupBy("_src", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_src").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_src", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    order = W.partitionBy("_src", "_part").orderBy("_hash")
    rows = rows.withColumn("_row", F.row_number().over(order) - 1).join(sizes, ["_src", "_part"])
    number = F.col("_row") + F.col("_before")
    # the period's slots of all sources in one literal array, each source's part beginning at its own offset
    flat, of = [], []
    for s, own_slots in slots.items():
        of.append((s, share[s], len(flat), None))
        flat += own_slots
    of += [(s, 1, 0, end + i) for i, s in enumerate(last)]
    places = F.split(F.lit(",".join(map(str, flat)) or "0"), ",").cast("array<int>")
    of = docs.sparkSession.createDataFrame(of, "_src string, _p long, _at long, _late long")
    rows = rows.join(F.broadcast(of), "_src").withColumns({"mix_block": F.floor(number / block_rows).cast("long"), "mix_place": F.pmod(number, F.lit(block_rows)).cast("long")})
    block = F.col("mix_block")
    late = F.col("_late") + block * len(last)
    slot = F.floor(block / F.col("_p")) * period + F.element_at(places, (F.col("_at") + F.pmod(block, F.col("_p")) + 1).cast("int"))
    rows = rows.withColumns(
        {
            "mix_release": F.coalesce(late, F.floor(block * period / F.col("_p")).cast("long")),
            "mix_deadline": F.coalesce(late + 1, F.ceil((block + 1) * period / F.col("_p")).cast("long")),
            "mix_slot": F.coalesce(late, slot.cast("long")),
        }
    )
    return rows.select("row.*", *COLUMNS)


#: The same in SQL, for weights that list one source, src0, at 0.1, which is there beside m others: of 10 m slots, less
#: what m and 9 have in common, src0 has m and each other 9. Blocks of 8 rows.
ORACLE = """
WITH RECURSIVE d AS (SELECT *, coalesce(source, chr(0) || 'none') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '') || coalesce(text, '')) AS h FROM documents),
s AS (SELECT src, CAST(count(*) OVER () - 1 AS BIGINT) AS m, row_number() OVER (ORDER BY src) AS k FROM (SELECT DISTINCT src FROM d)),
p AS (SELECT src, k, CASE WHEN src = 'src0' THEN m // gcd(m, 9) ELSE 9 // gcd(m, 9) END AS p, 10 * m // gcd(m, 9) AS q FROM s),
l AS (SELECT list(p ORDER BY k) AS ps, any_value(q) AS q FROM p),
e(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT slot, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick FROM (
    SELECT slot + 1 AS slot, done, CAST(list_sort(list_transform(list_filter(range(1, len(ps) + 1), lambda i: done[i] < ps[i] AND done[i] * q // ps[i] <= slot + 1),
      lambda i: [((done[i] + 1) * q + ps[i] - 1) // ps[i], i]))[1][2] AS BIGINT) AS pick
    FROM e, l WHERE slot < q - 1)),
t AS (SELECT slot, pick AS k, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM e WHERE slot >= 0),
n AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY h) - 1 AS row FROM d),
b AS (SELECT n.*, p.k, p.p, p.q, row // 8 AS block FROM n JOIN p USING (src))
SELECT doc_id, text, lang, source, n_chars, block AS mix_block, block * q // p AS mix_release,
  ((block + 1) * q + p - 1) // p AS mix_deadline, block // p * q + slot AS mix_slot, row % 8 AS mix_place
FROM b JOIN t ON t.k = b.k AND t.j = b.block % b.p
"""
