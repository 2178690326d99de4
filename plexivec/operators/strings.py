"""Similarity joins and profiles of short sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_mismatch_counts(df: DataFrame, key: str, sequence: str, output: str = "n") -> DataFrame:
    """``key, output``: other rows of equal length with exactly one letter different; equal rows count apart.

    Every sequence gives, for each place, a key with that letter masked.  Counts by masked key and by
    masked key with its letter are aggregates: the difference of the two is the number wanted, so no pair
    is formed and a common key is combined before the shuffle.
    """
    distinct = df.groupBy(F.col(sequence).alias("s")).agg(F.count("*").alias("c"))
    at = distinct.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s")))).withColumn("m", F.concat(F.expr("substring(s, 1, i - 1)"), F.lit("\x00"), F.expr("substring(s, i + 1)")))
    masked = at.groupBy("m").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    near = at.join(masked, "m").groupBy("s").agg(F.sum(F.col("all") - F.col("c")).alias("near"))
    return df.select(key, F.col(sequence).alias("_s")).join(near, F.col("_s") == F.col("s"), "left").select(key, F.coalesce("near", F.lit(0)).cast("long").alias(output))


def one_mismatch_pairs(df: DataFrame, sequence: str) -> DataFrame:
    """Distinct ``a, b`` (a < b) of sequences that differ in one letter."""
    s = df.select(F.col(sequence).alias("s")).distinct()
    at = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s")))).select("s", F.concat(F.expr("substring(s, 1, i - 1)"), F.lit("\x00"), F.expr("substring(s, i + 1)")).alias("m"))
    return at.withColumnRenamed("s", "a").join(at.withColumnRenamed("s", "b"), "m").filter("a < b").select("a", "b")
