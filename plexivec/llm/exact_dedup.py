"""Exact deduplication by two passes over a Bloom filter, DataFrame functions only.

The first pass sets, for every row's text hash, one position of a filter and keeps the positions that
were set more than once: the second filter.  The second pass tests every row against that filter.
Rows with a position that nobody else set are unique for certain and pass straight through; only the
others are shuffled by their hash to be grouped.

What the first pass shuffles is one number for each distinct position of a task, never a row.  Bitmaps
made inside the tasks would be larger: a block of 32,768 bits is 4 KB in every task that sets one of its
bits, as much as 512 positions, and at 32 bits a row it has 1,024 rows of the whole table; from three
tasks on the numbers are fewer bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.plans.skew import lookup
from plexivec.plans.staging import staged

#: Positions of the first filter for a row: about 3 % of unique rows share theirs with another row.
BITS_PER_ROW = 32
#: Bits of the second filter for a repeated position: another 6 % of unique rows at most are tested in vain.
BITS_PER_REPEAT = 16
#: The second filter is broadcast up to this many bytes, that is for 33 million repeated positions, however many rows there are.
BROADCAST_BYTES = 64 << 20
BLOCK_BITS = 32768


def _power(n: int) -> int:
    """The least power of two that is not below ``n`` and a block."""
    return max(BLOCK_BITS, 1 << math.ceil(math.log2(max(n, 1))))


def repeated_positions(rows: DataFrame) -> DataFrame:
    """``position, n``: the positions that two rows or more set, and the number of these rows."""
    return rows.groupBy("position").agg(F.count("*").alias("n")).filter("n > 1")


def folded(twice: DataFrame, bits: int) -> DataFrame:
    """The second filter: blocks (``block``, ``bits``) of the repeated positions modulo ``bits``."""
    at = twice.select(F.pmod("position", F.lit(bits)).alias("p"))
    block = F.expr("bitmap_bucket_number(p + 1)").alias("block")
    return at.groupBy(block).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits"))


def may_repeat(rows: DataFrame, twice: DataFrame, total: int) -> DataFrame:
    """``rows`` with a boolean ``maybe``: false only if no other row has the same hash.

    The second filter has bits for the repeated positions alone, not for all rows.  While it is small it is broadcast and
    no row moves.  With more repeated positions than that the rows are looked up by position in a shuffle, as a filter in
    pieces would have to read all rows once for each piece.
    """
    bits = _power(BITS_PER_REPEAT * twice.count())
    if bits // 8 > BROADCAST_BYTES:  # a text with a third of all rows makes its position a hot one
        found = lookup(rows, twice, ["position"], "n", total, F.xxhash64("row"))
        return found.select(*rows.columns, F.col("n").isNotNull().alias("maybe"))
    at = rows.withColumn("_p", F.pmod("position", F.lit(bits)))
    at = at.withColumn("block", F.expr("bitmap_bucket_number(_p + 1)")).withColumn("bit", F.expr("bitmap_bit_position(_p + 1)"))
    found = at.join(F.broadcast(folded(twice, bits)), "block", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")), F.lit(0)) == 1
    return found.select(*rows.columns, hit.alias("maybe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; of equal texts the row with the largest id stays.
    Null and empty texts are equal to each other.  Rows that repeat both an id and a text are one
    group of which exactly one row stays.  A null id is smaller than any other.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = staged(read.select("doc_id", "row", F.unhex("text_sha256").alias("sha")), "hashes")
    part = lambda a: F.conv(F.hex(F.substring("sha", a, 7)), 16, 10).cast("long")
    rows = rows.withColumn("h1", part(1)).withColumn("h2", part(8))
    total = rows.count()
    rows = rows.withColumn("position", F.pmod("h1", F.lit(_power(BITS_PER_ROW * total))))
    tested = may_repeat(rows, staged(repeated_positions(rows), "filter"), total)
    unique = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = staged(tested.filter("maybe").drop("maybe", "position"), "maybe")
    groups = staged(again.groupBy("h1", "h2", "sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last")), "groups")
    found = lookup(again, groups, ["h1", "h2", "sha"], "group_size", total, F.xxhash64("row"))
    grouped = found.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "sha")
    return unique.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
