"""Arrow batches of bounded size for Python operators that read texts, and rows dealt to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a batch, about; a longer row is a batch of its own.  Spark's default is 64 MB, held several times by
#: the JVM and by the Python worker of every core.
BATCH_BYTES = 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python batches of ``BATCH_BYTES`` unless it has a size of its own.

    The setting stays with the session, as Spark reads it when the plan runs.
    """
    conf = df.sparkSession.conf
    if conf.get(SETTING, None) is None:
        conf.set(SETTING, str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as a shuffle has: a small file of rows that take long is one task otherwise.

    The number is explicit, so adaptive execution does not join the parts again for being small.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
