"""Sample summaries kept up to date on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.functions.stats import size_weight


def windowed_descriptor(stream: DataFrame, time: str, sample: str, item: str, window: str = "1 hour", late: str = "1 hour", weight: str = "log1p") -> DataFrame:
    """``window_start, sample, n_items, n_eff`` of every window, as an append-mode streaming plan.

    Size weights are concave, so they need an item's final count: the first aggregation counts items within
    the window, the second sums weights of those counts.  Rows later than ``late`` are dropped.  Works on a
    batch frame alike.
    """
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), sample, item).agg(F.count("*").alias("a"))
    g = size_weight(F.col("a").cast("double"), weight)
    return counts.groupBy(F.window("w", window).alias("w"), sample).agg(F.count("*").alias("n_items"), (F.sum(g) * F.sum(g) / F.sum(g * g)).alias("n_eff")).select(F.col("w.start").alias("window_start"), sample, "n_items", "n_eff")
