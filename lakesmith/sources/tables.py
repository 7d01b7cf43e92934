"""Table sinks and sources (S5-S9, S17) over Parquet directories.

Delta is not available; the same guarantees come from Parquet plus Spark:
* overwrite (S8) replaces data and schema;
* append with schema evolution (S7) writes each batch into its own
  ``_batch_id=<id>`` partition with dynamic partition overwrite, so replaying
  a batch replaces itself instead of duplicating rows; readers merge schemas;
* registration (S9) creates the table over the location if missing and
  refreshes it — there is no drop/re-create window for concurrent readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_COL = "_batch_id"


def write_overwrite(df: DataFrame, path: str) -> str:
    """Replace the table at ``path`` (data and schema)."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_counted(df: DataFrame, path: str) -> int:
    """``write_overwrite`` that returns the number of rows written, observed in the same job."""
    rows = Observation("rows_written")
    write_overwrite(df.observe(rows, F.count(F.lit(1)).alias("rows")), path)
    return rows.get["rows"]


def append_batch(df: DataFrame, path: str, batch_id: str | int) -> str:
    """Append one batch under ``_batch_id``; replaying the same batch
    overwrites only its own partition (idempotent), new columns are allowed."""
    (df.withColumn(BATCH_COL, F.lit(str(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH_COL).parquet(path))
    return path


def read_table(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """A table directory as a DataFrame; schemas of batches are merged."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Only "path does not exist" means empty; any other read error is raised."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def register_table(spark: SparkSession, database: str, name: str, path: str, db_location: str | None = None) -> str:
    """External table over ``path`` — created when missing, refreshed otherwise."""
    if db_location is None:
        from lakesmith.session import checkpoint_root
        db_location = f"{checkpoint_root(spark)}/warehouse/{database}.db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{db_location}'")
    full = f"`{database}`.`{name}`"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {full} USING parquet LOCATION '{path}'")
    spark.sql(f"REFRESH TABLE {full}")
    return f"{database}.{name}"


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """Registered datasets of a database, metadata names excluded, sorted."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.name.startswith("_"))
