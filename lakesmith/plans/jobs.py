"""Composite jobs (M1-M6): the user-level API over table locations.

Each job reads its inputs from tables, runs DataFrame operators and writes
with the sinks of :mod:`lakesmith.sources.tables`; what reaches the driver are
batch numbers and bucket numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.functions.schema import business_columns, normalize_column_names
from lakesmith.operators import chunking as C
from lakesmith.operators import conversations as CV
from lakesmith.operators import medallion as M
from lakesmith.operators import retrieval as R
from lakesmith.sources import tables as ST
from lakesmith.streaming import ingest as IN


def run_bronze(spark: SparkSession, landing: str, bronze_path: str, checkpoint: str) -> DataFrame:
    """M1 (I1 I3 J2): ingest new raw files, return the bronze table."""
    IN.ingest_bronze(spark, landing, bronze_path, checkpoint)
    return ST.read_table(spark, bronze_path)


def run_silver(spark: SparkSession, bronze_path: str, silver_path: str, **silver_kwargs) -> DataFrame:
    """M2 (I4): every bronze batch reaches silver (the reference processed
    the dataset once and skipped later batches).  The merge by name is
    exact for any arrival order, so silver is re-derived from bronze; ids
    are stable — names already in silver keep theirs, new names continue at
    max + 1.  The old id table is cut with ``checkpoint()`` first, so the
    silver location can be overwritten while it is the id source.  For
    append-only growth, :func:`lakesmith.streaming.ingest.merge_into` with
    :func:`~lakesmith.streaming.ingest.unprocessed_batches` folds only new
    batches into a merged state."""
    from lakesmith.session import cut_lineage
    bronze = ST.read_table(spark, bronze_path).drop(ST.BATCH_COL)
    silver = M.to_silver(bronze, **silver_kwargs)
    old = IN.existing(spark, silver_path)
    if old is not None:
        candidates = silver_kwargs.get("name_candidates") or M.NAME_CANDIDATES
        name = next(c for c in candidates if c in silver.columns)
        ids = cut_lineage(old.select(name, M.SILVER_ID))
        stable = IN.assign_stable_ids(silver.select(name, M.BRONZE_ID), ids, name, [M.BRONZE_ID], M.SILVER_ID)
        silver = silver.drop(M.SILVER_ID).join(stable, name)
    ST.write_overwrite(silver, silver_path)
    return ST.read_table(spark, silver_path)


def fold_silver(name: str, order: Sequence[str]):
    """The fold of a silver batch into the touched buckets of the state: first non-NULL value per column in
    arrival order, ids kept, new names numbered from the next free id in first-seen order.  The row hash
    reads the columns of ``order``, in that order."""
    from lakesmith.functions.text import row_hash
    from lakesmith.operators.sequence import dense_id

    def fold(old: DataFrame | None, batch: DataFrame, next_id: int) -> DataFrame:
        have = set(old.columns) if old is not None else set()
        types = dict(batch.dtypes) | (dict(old.dtypes) if old is not None else {})
        cols = [c for c in types if c not in (name, M.BRONZE_ID, M.SILVER_ID, "row_hash")]
        null = lambda df, c: df if c in df.columns else df.withColumn(c, F.lit(None).cast(types[c]))
        for c in cols:
            batch = null(batch, c)
            old = null(old, c) if old is not None else None
        merged = IN.merge_into(old.drop(M.SILVER_ID, "row_hash") if have else None, batch, name, M.BRONZE_ID, cols)
        known = old.select(name, M.SILVER_ID) if have else None
        fresh = merged.select(name, M.BRONZE_ID)
        fresh = fresh.join(known, name, "left_anti") if have else fresh
        ids = dense_id(fresh, [M.BRONZE_ID], M.SILVER_ID, start=next_id).select(name, M.SILVER_ID)
        hashed = row_hash([c for c in order if c in merged.columns])
        return merged.withColumn("row_hash", hashed).join(known.unionByName(ids) if have else ids, name)

    return fold


def run_silver_buckets(spark: SparkSession, bronze_path: str, state_path: str, n_buckets: int = 64, **silver_kwargs) -> DataFrame:
    """M2 (I4 J4): fold the bronze batches that are not in the silver state yet, oldest first; only the
    buckets of their names are read and rewritten (:class:`lakesmith.streaming.bucketed.BucketedState`).

    The result equals silver derived from all batches at once: a batch is cleaned and merged on its own,
    then folded behind the earlier ones.  Running it again, or after a crash, changes nothing."""
    from lakesmith.streaming.bucketed import BucketedState
    bronze = ST.read_table(spark, bronze_path).withColumn(ST.BATCH_COL, F.col(ST.BATCH_COL).cast("int"))
    candidates = silver_kwargs.get("name_candidates") or M.NAME_CANDIDATES
    name = next(c for c in candidates if c in bronze.columns)
    state = BucketedState(spark, state_path, name, n_buckets)
    now = state.version()
    batches = sorted(r[0] for r in bronze.select(ST.BATCH_COL).distinct().collect())
    for batch_id in batches:
        if now is not None and batch_id <= now.last_batch:
            continue
        rows = bronze.where(F.col(ST.BATCH_COL) == batch_id).drop(ST.BATCH_COL)
        silver = M.to_silver(rows, **{"with_timestamps": False, **silver_kwargs}).drop(M.SILVER_ID, "row_hash")
        raw = business_columns(normalize_column_names(rows), M.ID_AND_AUDIT)
        order = [*raw, *(c for c in business_columns(silver, M.ID_AND_AUDIT) if c not in raw)]
        now = state.merge(silver, batch_id, fold_silver(name, order), M.SILVER_ID)
    return state.read()


def run_gold(spark: SparkSession, silver_path: str, gold_root: str, roles: Mapping[str, str] | None = None,
             dimensions: Sequence[tuple[str, str]] = M.DEFAULT_STAT_DIMENSIONS,
             quality_kwargs: Mapping[str, object] | None = None) -> dict[str, str]:
    """M3 (I5): full refresh of the four gold tables (overwrite)."""
    silver = ST.read_table(spark, silver_path)
    out = {}
    for name, df in M.to_gold(silver, roles, dimensions, quality_kwargs).items():
        out[name] = ST.write_overwrite(df, f"{gold_root.rstrip('/')}/{name}")
    return out


def build_index(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> dict[str, DataFrame]:
    """M4: documents -> keyed chunks with entity tags, and their postings."""
    ch = C.chunk_fixed(docs, text_col, size, overlap, keep=(id_col, source_col))
    chunks = ch.select(
        F.concat_ws(":", id_col, "chunk_no").alias("chunk_uid"), id_col, "chunk_no", source_col,
        F.col("chunk_text").alias("text"),
        R.chunk_key(F.col(source_col), F.col("chunk_start"), F.col("chunk_text")).alias("chunk_id"))
    tags = R.entity_tags(chunks, "chunk_uid", "text", lexicon).select("chunk_uid", "tags")
    chunks = chunks.join(tags, "chunk_uid", "left")
    return {"chunks": chunks, "postings": R.postings(chunks, "chunk_uid", "text")}


def retrieve(questions: DataFrame, scored: DataFrame) -> DataFrame:
    """M5: questions ``(query_id, text)`` and their scored hits ``(query_id, chunk_uid, source, text,
    rank, entity_score)`` -> one row per question with context, citations and the gate (R10).

    Hits are reranked by entity and retrieval rank; where no hit has an entity point that order is
    the retrieval order itself.  Ties go by source and chunk."""
    ranked = R.weighted_rerank(scored, tie_cols=("source", "chunk_uid")).withColumn("title", R.source_title(F.col("source")))
    ctx = R.context_text(ranked, "new_rank", "text", "title")
    cites = R.citations(ranked, "new_rank", "text", "title")
    gate = R.answer_gate(questions.select("query_id"), scored)
    return gate.join(ctx.drop("n_docs"), "query_id", "left").join(cites, "query_id", "left")


def maintain_conversations(turns: DataFrame, store: str) -> dict[str, str]:
    """M6 (S16): sessions with backfilled keys, counters and the paired
    chat history written to the store."""
    from lakesmith.operators.sequence import dense_id
    sessions = turns.select("conv_id", "role").distinct()
    users = dense_id(sessions.select("role").distinct(), ["role"], "user_id").withColumnRenamed("role", "username")
    s = sessions.join(users, sessions["role"] == users["username"]).select("conv_id", "user_id")
    keyed = CV.backfill_session_keys(s, users, order=["conv_id"])
    counters = keyed.groupBy("user_id").agg(
        F.max(CV.session_number(F.col("session_key"), F.col("username"))).alias("last_session_number"))
    history = CV.qa_pairs(turns)
    return {
        "chat_sessions": ST.write_overwrite(keyed, f"{store}/chat_sessions"),
        "chat_session_counters": ST.write_overwrite(counters, f"{store}/chat_session_counters"),
        "chat_history": ST.write_overwrite(history, f"{store}/chat_history"),
    }
