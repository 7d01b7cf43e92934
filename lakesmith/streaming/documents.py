"""Document files -> tagged chunk index, incrementally.

A ``binaryFile`` stream hands new files over in micro-batches; every batch becomes rows of four tables, each
under its ``_batch_id`` (so a batch that comes again replaces itself):

* ``files``   every file with its ETag (MD5 of the content) and what became of it: ``loaded``, ``repeated``
  (that content is indexed already, in an earlier batch or by an earlier path of this one) or ``rejected``
  (Spark's file source hands no files of zero bytes over);
* ``documents`` the texts of the loaded files, one row per file or per row of a table file;
* ``chunks``  their chunks with entity tags and content keys, without the keys that are indexed already;
* ``counters`` a row per batch: files by status, documents, chunks cut and chunks added.

A batch sees the tables as they were before it, so a replay finds the same repeats.  File contents are read
by the executors; the driver sees no path and no content.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesmith.operators import chunking as C
from lakesmith.operators import retrieval as R
from lakesmith.session import cut_lineage
from lakesmith.sources.files import DOCUMENT_SUFFIXES, docx_text, extension, table_documents
from lakesmith.sources.tables import BATCH_COL, append_batch, table_exists
from lakesmith.streaming.ingest import BINARY_FILE_SCHEMA, MAX_FILES_PER_TRIGGER, _run, existing

# Suffixes that the dispatch accepts but no reader of this library can open.
UNREADABLE = {".pdf": "pdf text extraction not available"}
TEXT_SUFFIXES = (".txt", ".md")
TABLE_FILES = (".csv", ".xlsx")
STATUSES = ("loaded", "repeated", "rejected")


def file_states(batch: DataFrame, earlier: DataFrame | None, suffixes: Sequence[str] = DOCUMENT_SUFFIXES) -> DataFrame:
    """``(path, length, ext, etag, status, reason)`` of a batch of files ``(path, length, content)``.

    The first path of an ETag is loaded, the others of the batch are repeated; so are all whose ETag is
    among the ``loaded`` files of ``earlier`` (the reference skips a processed ETag wherever it lies)."""
    ext = extension()
    unreadable = F.create_map(*[F.lit(x) for kv in UNREADABLE.items() for x in kv])
    reason = (F.when(~ext.isin(*suffixes), F.lit("unsupported suffix")).when(ext.isin(*UNREADABLE), unreadable[ext]))
    files = batch.select("path", "length", ext.alias("ext"), F.md5("content").alias("etag"), reason.alias("reason"))
    # the contents are read and hashed once; what moves are rows without content
    files = files.withColumn("__first", F.min(F.when(F.col("reason").isNull(), F.col("path"))).over(Window.partitionBy("etag")))
    repeated = F.col("path") != F.col("__first")
    if earlier is not None:
        known = earlier.where("status = 'loaded'").select("etag").distinct().withColumn("__known", F.lit(True))
        files = files.join(known, "etag", "left")
        repeated = repeated | F.col("__known").isNotNull()
    status = F.when(F.col("reason").isNotNull(), "rejected").when(repeated, "repeated").otherwise("loaded")
    return files.select("path", "length", "ext", "etag", status.alias("status"), "reason")


def file_documents(files: DataFrame) -> DataFrame:
    """``(source, doc_no, text)`` of accepted files ``(path, ext, content)``: text and Markdown whole (bytes
    that are not UTF-8 become the replacement character), DOCX paragraphs, table files row by row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                texts = [docx_text(bytes(content))] if ext == ".docx" else table_documents(bytes(content), ext)
                yield pd.DataFrame({"source": path, "doc_no": range(len(texts)), "text": texts})

    schema = "source string, doc_no long, text string"
    plain = files.where(F.col("ext").isin(*TEXT_SUFFIXES)).select(
        F.col("path").alias("source"), F.lit(0).cast("long").alias("doc_no"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return plain.unionByName(files.where(F.col("ext").isin(".docx", *TABLE_FILES)).select("path", "ext", "content").mapInPandas(parse, schema))


def keyed_chunks(documents: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """``(source, doc_no, chunk_no, text, chunk_id)`` of documents ``(source, doc_no, text)``."""
    ch = C.chunk_fixed(documents, "text", size, overlap, keep=("source", "doc_no"))
    return ch.select("source", "doc_no", "chunk_no", F.col("chunk_text").alias("text"),
                     R.chunk_key(F.col("source"), F.col("chunk_start"), F.col("chunk_text")).alias("chunk_id"))


def ingest_files(spark: SparkSession, landing: str, store: str, checkpoint: str, lexicon: DataFrame,
                 source: Column | None = None, suffixes: Sequence[str] = DOCUMENT_SUFFIXES) -> None:
    """All new files below ``landing`` into the tables below ``store``.  ``source`` names a file in
    the index (default: its path) from the column ``path``.  Without new files nothing is written."""
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", MAX_FILES_PER_TRIGGER).load(landing))
    _run(stream, checkpoint, lambda batch, batch_id: index_batch(spark, batch, batch_id, store, lexicon, source, suffixes))


def index_batch(spark: SparkSession, batch: DataFrame, batch_id: int, store: str, lexicon: DataFrame,
                source: Column | None = None, suffixes: Sequence[str] = DOCUMENT_SUFFIXES) -> None:
    """One micro-batch of files.  What a later step reads is taken from the table just written, so contents
    are hashed once and parsed once."""
    store = store.rstrip("/")
    before = lambda name: existing(spark, f"{store}/{name}", before_batch=batch_id)

    def written(name: str) -> DataFrame | None:
        path = f"{store}/{name}/{BATCH_COL}={batch_id}"
        return spark.read.parquet(path) if table_exists(spark, path) else None

    append_batch(file_states(batch, before("files"), suffixes), f"{store}/files", batch_id)
    files = written("files")
    if files is None:
        return
    # at most MAX_FILES_PER_TRIGGER paths: the contents stay where they are read
    wanted = F.broadcast(files.where("status = 'loaded'").select("path", "ext"))
    documents = file_documents(batch.select("path", "content").join(wanted, "path"))
    if source is not None:
        documents = documents.withColumnRenamed("source", "path").withColumn("source", source)
    append_batch(documents.select("source", "doc_no", "text"), f"{store}/documents", batch_id)
    n_documents = n_cut = n_added = 0
    stored = written("documents")
    if stored is not None:
        n_documents = stored.count()
        chunks = keyed_chunks(stored)
        n_cut = chunks.select("chunk_no").count()
        old = before("chunks")
        if old is not None:
            # the key holds the source: only chunks of this batch's sources (a name per file) can be there already
            names = F.broadcast(stored.select(F.col("source").alias("__name")).distinct())
            old = old.join(names, F.col("source").eqNullSafe(F.col("__name")), "left_semi")
        new = cut_lineage(R.upsert_new(old if old is not None else chunks.limit(0), chunks, "chunk_id", ["source", "doc_no", "chunk_no"]))
        tagged = new.join(R.entity_tags(new, "chunk_id", "text", lexicon).select("chunk_id", "tags"), "chunk_id")
        append_batch(tagged, f"{store}/chunks", batch_id)
        added = written("chunks")
        n_added = added.count() if added is not None else 0
    counters = files.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
                         *[F.lit(n).cast("long").alias(c) for c, n in (("documents", n_documents), ("chunks_cut", n_cut), ("chunks_added", n_added))])
    append_batch(counters, f"{store}/counters", batch_id)
