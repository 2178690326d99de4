"""Dense row numbers without a sort, and keyed permutations of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.plans.staging import staged

_BITS = 33  # of the place within a partition, as Spark numbers rows


def numbered(df: DataFrame, output: str) -> DataFrame:
    """``df``, staged, with the numbers 0, 1, 2, ... of its rows: those of the partitions before, and the place in the own one."""
    rows = staged(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", _BITS)
    ahead = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row a partition
    before = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    out = rows.withColumn("_part", part).join(before, "_part")
    return out.withColumn(output, F.col("_ahead") + F.col("_place").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_part", "_place", "_ahead")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permuted(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. ``n`` - 1 for each key: Feistel rounds on an even number of bits, again while the result is not below ``n``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.uint64(key & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out, open_ = x.astype(np.uint64), np.arange(len(x))
        while len(open_):
            left, right = out[open_] >> half, out[open_] & mask
            for k in keys:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
            out[open_] = left << half | right
            open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted_number(number: Column, n: int, key: int) -> Column:
    """``permuted`` of a column of row numbers."""

    @F.pandas_udf("bigint")
    def moved(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, key))

    return moved(number)


def with_permuted(df: DataFrame, number: str, column: str, n: int, key: int) -> DataFrame:
    """``df`` (``numbered``, ``n`` rows) with ``column`` of another row in each row: every value is used once."""
    moved = df.select(permuted_number(F.col(number), n, key).alias("_to"), F.col(column).alias("_other"))
    return df.join(moved, F.col(number) == F.col("_to")).withColumn(column, F.col("_other")).drop("_to", "_other")
