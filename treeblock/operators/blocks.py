"""Block layout, index validation and checksums, over frames of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of a block's magic, header size field and header (fixed values).
HEADER = 54
ZERO_MD5 = b"\0" * 16


def offsets(blocks: DataFrame, order: str, length: Column, start: int = 0, width: int = 4096, keys: list[str] | None = None) -> DataFrame:
    """blocks with header_pos, data_pos and end of each block of a file, laid out in the order of an integer column.

    A running sum in two levels: within buckets of width places, and over the buckets' sums, so that no task holds a
    file's blocks but width of them and the sums.
    """
    keys = keys or []
    rows = blocks.withColumn("_len", length.cast("bigint") + HEADER).withColumn("_b", F.floor(F.col(order) / width))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_len").alias("_s"))
    over = W.partitionBy(*keys).orderBy("_b") if keys else W.orderBy("_b")
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_len").over(W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_in", inside).join(sums, [*keys, "_b"])
    pos = F.lit(start) + F.col("_before") + F.col("_in")
    return rows.withColumns({"header_pos": pos, "data_pos": pos + HEADER, "end": pos + F.col("_len")}).drop("_len", "_b", "_in", "_before")


def header_problem(flags: Column, compression: Column, allocated: Column, used: Column, data: Column, header_size: Column) -> Column:
    """Why a block's header is not valid, or null. Streamed blocks (flag 1) have no sizes to check."""
    streamed = flags.bitwiseAND(F.lit(1)) == 1
    return (
        F.when((header_size < 48) | (header_size > 65536), "header_size")
        .when(streamed, None)
        .when(allocated < used, "allocated_size")
        .when((compression == "") & (data != used), "data_size")
    )


def index_rejection(offsets: Column, walked: Column, magic: Column | None = None, last_adjacent: Column | None = None) -> Column:
    """Why a block index is not used, or null: offsets as the index has them (null: unparseable), as the walk found
    them, whether each offset points at a block, and whether the last block ends where the index begins."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(offsets) - 1, F.lit(1))), lambda i: (F.size(offsets) < 2) | (F.get(offsets, i - 1) < F.get(offsets, i)))
    out = F.when(offsets.isNull(), "unparseable").when(~rising, "not_monotonic").when(F.size(offsets) != F.size(walked), "count_mismatch")
    out = out.when((F.size(offsets) > 0) & (F.get(offsets, F.lit(0)) != F.get(walked, F.lit(0))), "first_offset_mismatch")
    if magic is not None:
        out = out.when(~magic, "not_block_magic")
    if last_adjacent is not None:
        out = out.when(~last_adjacent, "last_block_not_adjacent")
    return out


def checksum_status(stored: Column, raw: Column, data: Column | None = None, lenient: Column | None = None) -> Column:
    """absent (all zeros), valid or invalid, of the stored MD5 against the stored bytes; where lenient is true, against
    the decompressed ones too."""
    ok = F.md5(raw) == F.lower(F.hex(stored))
    if data is not None and lenient is not None:
        ok = ok | (lenient & (F.md5(data) == F.lower(F.hex(stored))))
    return F.when(stored == F.lit(ZERO_MD5), "absent").when(ok, "valid").otherwise("invalid")
