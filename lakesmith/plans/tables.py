"""Reading the driver's tables (S5): one parquet file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, spread_on: str | None = None) -> DataFrame:
    """A driver table; ``spread_on`` guards CPU-heavy row work against an
    under-split scan (see :func:`lakesmith.operators.parallel.spread`)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_on:
        from lakesmith.operators.parallel import spread
        df = spread(df, spread_on, probe=True)
    return df


def table_files(spark: SparkSession, sf_dir: str, name: str) -> tuple[tuple[str, int, int], ...]:
    """``(path, length, modification time)`` of a driver table's files: a table that was written again, or
    has one file more, gives another value.  Read through Spark's file system, no job runs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
