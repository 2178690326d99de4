"""Looking up one row per group when a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more groups than this are ever broadcast (each holds at least ``total / MAX_HOT`` rows).
MAX_HOT = 4000
MIN_HOT = 500


def hot_size(total: int) -> int:
    """Rows from which a group counts as hot; at most ``MAX_HOT`` groups can reach it."""
    return max(MIN_HOT, -(-total // MAX_HOT))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: Column, how: str = "left", largest: int | None = None) -> DataFrame:
    """Join every row with the row of its group.

    ``keys`` name columns of both sides, the first of type long; ``groups`` has one row per key, with
    its number of rows in the column ``size``.  The few groups of ``hot_size(total)`` rows or more are
    broadcast: their number has the bound ``MAX_HOT`` whatever the data.  All others are joined by a
    shuffle in which the rows of hot groups are spread by ``spread`` (a long) and match nothing.
    ``largest`` is the size of the largest group, if known: where it is not hot, one plain join does, and
    the driver has no broadcast to hold.
    """
    least = hot_size(total)
    values = [c for c in groups.columns if c not in keys]
    if largest is not None and largest < least:
        known = groups.filter(F.col(size).isNotNull()).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], *values)
        joined = rows.join(known, [F.col(k).eqNullSafe(F.col(f"_cold_{k}")) for k in keys], how)
        return joined.select(*rows.columns, *values)
    hot = groups.filter(F.col(size) >= least).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = groups.filter(F.col(size) < least).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], *[F.col(v).alias(f"_cold_{v}") for v in values], F.lit(True).alias("_cold"))
    near = rows.join(F.broadcast(hot), [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys], "left")
    is_hot = F.col(f"_hot_{size}").isNotNull()
    near = near.withColumn("_deal", F.when(is_hot, spread).otherwise(F.col(keys[0]))).withColumn("_open", ~is_hot)
    on = [F.col("_deal").eqNullSafe(F.col(f"_cold_{keys[0]}")), F.col("_open") == F.col("_cold")]
    on += [F.col(k).eqNullSafe(F.col(f"_cold_{k}")) for k in keys[1:]]
    joined = near.join(cold, on, "left")
    out = joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"_hot_{v}"), F.col(f"_cold_{v}")).alias(v) for v in values])
    return out.filter(F.col(size).isNotNull()) if how == "inner" else out


def lookup_value(rows: DataFrame, column: str, groups: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each value of ``column``, not ``size``); hot values as in ``lookup``, values without a group get nulls."""
    key = F.xxhash64(F.col(column) + F.lit(0))  # 0.0 and -0.0 are one value
    met = lookup(rows.withColumn("_key", key), groups.withColumn("_key", key), ["_key", column], size, total, F.monotonically_increasing_id())
    return met.drop("_key", size)
