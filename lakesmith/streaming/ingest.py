"""Incremental ingestion with Structured Streaming.

The reference polls a bucket and keeps a processed-file log it reads back
to the driver.  Here the file-source stream *is* the log: its checkpoint
records which files were handed to which micro-batch, ``availableNow``
processes whatever is new and stops, and ``foreachBatch`` writes each
micro-batch into its own ``_batch_id`` partition with dynamic partition
overwrite, so a batch replayed after a failure replaces itself (no
duplicates, no lost files).  Surrogate ids continue from the table's max.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.functions.text import normalize_name
from lakesmith.operators.medallion import BRONZE_ID, merge_by_name, next_id, to_bronze
from lakesmith.operators.sequence import dense_id
from lakesmith.sources.files import TABLE_SUFFIXES, extension, read_csv_files, read_xlsx_files
from lakesmith.sources.tables import BATCH_COL, append_batch, read_table, table_exists

MAX_FILES_PER_TRIGGER = 1000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _run(stream: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None]) -> None:
    # a micro-batch names its files one by one, and Spark would look at every one in a task of its own
    spark = stream.sparkSession
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        q = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(LISTING_TASKS, before)


def existing(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame | None:
    """The table at ``path`` (``None`` if it does not exist yet).  With
    ``before_batch`` only earlier micro-batches are returned: a batch that is
    replayed after a failure must see the table as it was before its first
    attempt, or it would count its own rows as already present."""
    if not table_exists(spark, path):
        return None
    df = read_table(spark, path)
    if before_batch is not None and BATCH_COL in df.columns:
        df = df.where(F.col(BATCH_COL).cast("long") < before_batch)
    return df


def ingest_bronze(spark: SparkSession, landing: str, table_path: str, checkpoint: str,
                  suffixes: Sequence[str] = TABLE_SUFFIXES) -> None:
    """New CSV/XLSX files under ``landing`` -> bronze rows
    appended to ``table_path``; ``cd_bronze_id`` continues at max + 1 in
    (file, row) order.  Running it again without new files adds nothing."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("maxFilesPerTrigger", MAX_FILES_PER_TRIGGER).load(landing).select("path").where(extension().isin(*suffixes)))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # file names of this micro-batch (bounded by maxFilesPerTrigger)
        paths = sorted(r[0] for r in batch.collect())
        if not paths:
            return
        csvs = [p for p in paths if p.lower().endswith(".csv")]
        books = [p for p in paths if not p.lower().endswith(".csv")]
        frames = []
        if csvs:
            frames.append(read_csv_files(spark, csvs))
        if books:
            frames.append(read_xlsx_files(spark, spark.read.format("binaryFile").load(books)))
        raw = frames[0]
        for f in frames[1:]:
            raw = raw.unionByName(f, allowMissingColumns=True)
        start = next_id(existing(spark, table_path, before_batch=batch_id), BRONZE_ID)
        bronze = to_bronze(raw.drop("_source_file"), ["_source_uri", "_row_no"],
                           source_file=F.substring_index("_source_uri", "/", -1),
                           source_uri=F.col("_source_uri"), start_id=start)
        append_batch(bronze.drop("_row_no"), table_path, batch_id)

    _run(files, checkpoint, handle)


def merge_into(state: DataFrame | None, new_rows: DataFrame, name_col: str, order_col: str,
               cols: Sequence[str]) -> DataFrame:
    """I4 A4: fold a new batch into the merged-by-name state.

    New rows always come later in ingest order, so a column keeps its state
    value and only fills from the batch when the state had none — the same
    result as merging all rows at once.  Only names touched by the batch
    change (full outer join by name)."""
    new = merge_by_name(new_rows, name_col, order_col, cols)
    if state is None:
        return new
    s, n = state.alias("s"), new.alias("n")
    j = s.join(n, F.col(f"s.{name_col}") == F.col(f"n.{name_col}"), "full_outer")
    return j.select(F.coalesce(F.col(f"s.{name_col}"), F.col(f"n.{name_col}")).alias(name_col),
                    F.least(F.col(f"s.{order_col}"), F.col(f"n.{order_col}")).alias(order_col),
                    *[F.coalesce(F.col(f"s.{c}"), F.col(f"n.{c}")).alias(c) for c in cols])


def assign_stable_ids(names: DataFrame, ids: DataFrame | None, name_col: str, order: Sequence[str],
                      id_col: str) -> DataFrame:
    """Hard part 1: ids never move — existing names keep theirs, only new
    names (``left_anti``) get dense ids continuing at max + 1."""
    if ids is None:
        return dense_id(names.select(name_col, *order), list(order), id_col).select(name_col, id_col)
    fresh = names.select(name_col, *order).join(ids.select(name_col), name_col, "left_anti")
    new_ids = dense_id(fresh, list(order), id_col, start=next_id(ids, id_col)).select(name_col, id_col)
    return ids.select(name_col, id_col).unionByName(new_ids)


def ingest_documents(spark: SparkSession, landing: str, schema: str, index_path: str, checkpoint: str,
                     build: Callable[[DataFrame], DataFrame], key: str, order: Sequence[str]) -> None:
    """New document drops -> ``build`` (chunk, tag, key) -> only keys
    not yet in the index are appended (R9 upsert)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", MAX_FILES_PER_TRIGGER).parquet(landing)

    def handle(batch: DataFrame, batch_id: int) -> None:
        from lakesmith.operators.retrieval import upsert_new
        rows = build(batch)
        old = existing(spark, index_path, before_batch=batch_id)
        new = upsert_new(old if old is not None else rows.limit(0), rows, key, list(order))
        append_batch(new, index_path, batch_id)

    _run(stream, checkpoint, handle)


def normalized_names(df: DataFrame, name_col: str) -> DataFrame:
    return df.withColumn(name_col, normalize_name(name_col)).where(F.col(name_col).isNotNull())


def unprocessed_batches(source: DataFrame, processed: DataFrame | None, batch_col: str = BATCH_COL) -> DataFrame:
    """Rows of ``source`` whose batch id is not yet in ``processed``
    (``left_anti`` on the batch id; the reference keyed the whole dataset,
    so later bronze batches never reached silver)."""
    if processed is None:
        return source
    done = processed.select(batch_col).distinct()
    return source.join(done, batch_col, "left_anti")
