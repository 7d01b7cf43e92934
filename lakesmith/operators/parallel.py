"""Parallelism guard for CPU-heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _busy_partitions(df: DataFrame) -> int:
    """Number of scan partitions that hold rows.  For a raw file scan no
    column is read (row counts come from the file footers)."""
    from pyspark.sql import functions as F
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None,
           probe: bool = False) -> DataFrame:
    """Hash-repartition ``df`` on ``key`` only when it has fewer partitions
    than the session's parallelism.

    A table stored as one large row group scans as a single task, and every
    narrow operator above it (tokenising, regex cleaning, per-document
    Python scoring) would run on one core.  The check reads the planned
    partition count (no job); on cluster-scale inputs with many splits it is
    a no-op and adds no shuffle.

    A round-robin ``repartition(n)`` is used on purpose: AQE coalesces a
    hash ``repartition(n, col)`` of small data back into one partition, but
    never a shuffle whose partition number the user fixed; unlike a range
    repartition it needs no sampling pass over the input, and Spark sorts
    before a round-robin split so a retried task gets the same rows.  ``key``
    is accepted for callers that document their row key."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    planned = df.rdd.getNumPartitions()
    if planned >= 4 * target:
        return df
    # few splits: with ``probe`` (raw scans only) count the splits that hold rows —
    # one large row group plans as several splits of which one carries all data
    if (_busy_partitions(df) if probe else planned) >= target:
        return df
    return df.repartition(target)
