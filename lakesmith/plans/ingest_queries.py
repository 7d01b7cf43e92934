"""File, sink and incremental queries.  Their input files are written by
Spark from the driver tables (``part`` as CSV drops with messy headers,
``documents`` as Parquet drops) into a fresh folder under the shared
checkpoint location, so the work grows with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.operators.medallion import BRONZE_ID, to_bronze
from lakesmith.plans.retrieval_queries import _keyed_chunks
from lakesmith.plans.tables import table
from lakesmith.session import scratch_path
from lakesmith.sources import files as SF
from lakesmith.sources import tables as ST
from lakesmith.streaming import ingest as IN

# Raw sheet headers as a user would type them (sanitised to part_key, name, …).
PART_HEADERS = {"p_partkey": "Part Key", "p_name": "Name", "p_brand": "Brand ", "p_type": "Type",
                "p_size": "Size", "p_retailprice": "Retail Price"}


def _mid(df: DataFrame, col: str):
    return df.select(F.max(col) / 2).scalar()


def write_part_csv(spark, d, landing: str, where=None, files: int = 4) -> None:
    part = table(spark, d, "part")
    if where is not None:
        part = part.where(where)
    out = part.select(*[F.col(c).alias(h) for c, h in PART_HEADERS.items()])
    (out.repartitionByRange(files, F.col("Part Key")).sortWithinPartitions("Part Key")
     .write.mode("append").option("header", "true").csv(landing))


def q_csv_bronze(spark, d):
    """List the CSV drop, read every file with one
    header rule, bronze with ids in (file, row) order."""
    landing = scratch_path(spark, "landing_csv")
    write_part_csv(spark, d, landing)
    paths = [r.path for r in SF.list_files(spark, landing).select("path").collect()]
    raw = SF.read_csv_files(spark, paths)
    bronze = to_bronze(raw.drop("_source_file"), ["_source_uri", "_row_no"],
                       source_file=F.substring_index("_source_uri", "/", -1), source_uri=F.col("_source_uri"),
                       with_timestamps=False)
    return bronze.select("part_key", "name", "brand", "type", "size", "retail_price", BRONZE_ID)


def q_bronze_incremental(spark, d):
    """Two CSV drops ingested by an availableNow file stream; a
    run without new files adds nothing; ids continue across runs."""
    landing, tbl, ck = (scratch_path(spark, n) for n in ("landing_inc", "bronze_inc", "bronze_inc_ckpt"))
    part = table(spark, d, "part")
    mid = _mid(part, "p_partkey")
    write_part_csv(spark, d, landing, F.col("p_partkey") <= mid, files=2)
    IN.ingest_bronze(spark, landing, tbl, ck)
    IN.ingest_bronze(spark, landing, tbl, ck)          # no new files: no batch
    write_part_csv(spark, d, landing, F.col("p_partkey") > mid, files=2)
    IN.ingest_bronze(spark, landing, tbl, ck)
    return ST.read_table(spark, tbl).select("part_key", "name", BRONZE_ID, F.col(ST.BATCH_COL).cast("string").alias(ST.BATCH_COL))


def q_silver_incremental(spark, d):
    """Part arrives in two batches; folding the second into the
    merged state equals merging everything at once (``merge_by_name``)."""
    part = IN.normalized_names(table(spark, d, "part"), "p_name")
    mid = _mid(part, "p_partkey")
    cols = ["p_brand", "p_type", "p_size", "p_retailprice"]
    state = IN.merge_into(None, part.where(F.col("p_partkey") <= mid), "p_name", "p_partkey", cols)
    state = IN.merge_into(state, part.where(F.col("p_partkey") > mid), "p_name", "p_partkey", cols)
    return state.withColumnRenamed("p_partkey", "first_partkey")


def q_silver_buckets(spark, d):
    """Part reaches bronze in two batches; each is folded into the bucketed silver state, of which
    only the buckets of its names are rewritten.  The state equals silver derived from everything at once."""
    from lakesmith.plans import jobs
    from lakesmith.plans.medallion_queries import part_bronze
    bronze_path, state = scratch_path(spark, "bronze_batches"), scratch_path(spark, "silver_state")
    bronze = part_bronze(spark, d)
    mid = _mid(bronze, BRONZE_ID)
    for batch, rows in enumerate((bronze.where(F.col(BRONZE_ID) <= mid), bronze.where(F.col(BRONZE_ID) > mid))):
        ST.append_batch(rows, bronze_path, batch)
        silver = jobs.run_silver_buckets(spark, bronze_path, state, name_candidates=("p_name",), dose_col="p_size")
    return silver.drop("_source_uri")


def q_index_incremental(spark, d):
    """Two document drops streamed into the chunk index; the
    second run appends only chunks whose key is new."""
    landing, idx, ck = (scratch_path(spark, n) for n in ("landing_docs", "chunk_index", "chunk_index_ckpt"))
    docs = table(spark, d, "documents")
    mid = _mid(docs, "doc_id")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    build = lambda b: _keyed_chunks(b)
    docs.where(F.col("doc_id") <= mid).write.mode("append").parquet(landing)
    IN.ingest_documents(spark, landing, schema, idx, ck, build, "chunk_id", ["doc_id", "chunk_no"])
    docs.where(F.col("doc_id") > mid).write.mode("append").parquet(landing)
    IN.ingest_documents(spark, landing, schema, idx, ck, build, "chunk_id", ["doc_id", "chunk_no"])
    return ST.read_table(spark, idx).select("doc_id", "chunk_no", "chunk_id",
                                            (F.col(ST.BATCH_COL).cast("int") + 1).alias("batch"))


DOCS_PER_FILE = 20


def _drop_files(spark, d, folder: str, docs: DataFrame) -> None:
    """A drop of files that Spark writes: texts of twenty neighbouring documents a file, supplier rows as
    CSV files, and nations as JSON, which no reader accepts.  The text files lie in one folder, so that the
    stream lists them by one call and not by a task per file."""
    SF.write_text_files(docs, f"{folder}/text", F.concat(F.lit("file_no="), F.floor(F.col("doc_id") / DOCS_PER_FILE), F.lit(".txt")), order=["doc_id"])
    (table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("file_no"), F.col("s_suppkey").alias("Supp Key"), F.col("s_name").alias("Name"),
                                        F.col("s_nationkey").alias("Nation Key"))
     .repartition("file_no").sortWithinPartitions("file_no", "Supp Key").write.partitionBy("file_no").option("header", "true").csv(f"{folder}/csv"))
    table(spark, d, "nation").coalesce(1).write.json(f"{folder}/json")


def q_file_index(spark, d):
    """Two drops of files streamed into the tagged chunk index.  The second holds the first
    files of the first drop again, all its CSV files and files that are rejected; a run without new files
    adds nothing.  Files, chunks and summed counters as one relation."""
    from lakesmith.plans.retrieval_queries import herb_lexicon
    from lakesmith.streaming.documents import ingest_files
    landing, store, ck = (scratch_path(spark, n) for n in ("landing_files", "file_index", "file_index_ckpt"))
    docs = table(spark, d, "documents")
    mid = _mid(docs, "doc_id")
    name = F.concat(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), F.lit("-"), F.regexp_extract("path", "file_no=([0-9]+)", 1))
    lexicon = herb_lexicon(spark, d)
    _drop_files(spark, d, f"{landing}/d1", docs.where(F.col("doc_id") <= mid))
    ingest_files(spark, landing, store, ck, lexicon, source=name)
    ingest_files(spark, landing, store, ck, lexicon, source=name)      # no new files: no batch
    _drop_files(spark, d, f"{landing}/d2", docs.where((F.col("doc_id") > mid) | (F.col("doc_id") < 5 * DOCS_PER_FILE)))
    ingest_files(spark, landing, store, ck, lexicon, source=name)
    row = lambda kind, key, value, n: (F.lit(kind).alias("kind"), key.alias("name"), value.alias("value"), n.cast("long").alias("n"))
    files = ST.read_table(spark, f"{store}/files").select(*row("file", name, F.concat_ws(
        ":", "status", F.when(F.col("status") != "rejected", F.col("etag")), "reason"), F.when(F.col("status") != "rejected", F.col("length"))))
    chunks = ST.read_table(spark, f"{store}/chunks").select(*row("chunk", F.concat_ws(":", "source", "doc_no", "chunk_no"), F.concat_ws(
        ":", "chunk_id", "tags"), F.length("text")))
    counters = ST.read_table(spark, f"{store}/counters")
    names = [c for c in counters.columns if c != ST.BATCH_COL]
    summed = counters.agg(*[F.sum(c).alias(c) for c in names]).select(F.inline(F.array(*[
        F.struct(F.lit("counter").alias("kind"), F.lit(c).alias("name"), F.lit(None).cast("string").alias("value"), F.col(c).alias("n")) for c in names])))
    return files.unionByName(chunks).unionByName(summed)


def q_schema_evolution(spark, d):
    """Two batches with different columns appended to one table
    (batch 0 replayed once: idempotent), read back with merged schema."""
    path = scratch_path(spark, "evolving")
    part = table(spark, d, "part")
    mid = _mid(part, "p_partkey")
    first = part.where(F.col("p_partkey") <= mid).select("p_partkey", "p_name", "p_brand")
    ST.append_batch(first, path, 0)
    ST.append_batch(part.where(F.col("p_partkey") > mid).select("p_partkey", "p_name", "p_type", "p_size"), path, 1)
    ST.append_batch(first, path, 0)
    return ST.read_table(spark, path).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", ST.BATCH_COL)


def q_table_roundtrip(spark, d):
    """Overwrite with the count of written rows, list, register an external table, query it with SQL."""
    path = scratch_path(spark, "part_table")
    written = ST.write_counted(table(spark, d, "part"), path)
    name = ST.register_table(spark, "lakesmith", f"part_{uuid.uuid4().hex[:8]}", path)
    listed = name.split(".")[1] in ST.list_tables(spark, "lakesmith")
    return spark.sql(f"SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS revenue FROM {name} GROUP BY p_brand") \
        .select("*", F.lit(written).cast("long").alias("rows_written"), F.lit(listed).alias("listed"))


TEXT_FOLDERS = 256


def q_text_documents(spark, d):
    """Every document becomes its own text file, in folders by its key; the loader lists the
    tree, dispatches by suffix and reads each file whole as one document."""
    landing = scratch_path(spark, "landing_text")
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    name = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(TEXT_FOLDERS)), F.lit("/doc_id="),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".txt"))
    SF.write_text_files(docs, landing, name)
    loaded, rejected = SF.load_documents(spark, landing)
    # the text writer ends each record with one line separator
    return loaded.select(F.regexp_extract("source", r"doc_id=([0-9]+)", 1).cast("long").alias("doc_id"),
                         F.regexp_replace("text", r"\n\z", "").alias("text"))
