"""The composite jobs run as jobs: tables on disk in, tables on disk out, read back as one relation
``(table_name, key, value)``.  Audit columns are counted where they hold what they should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.operators import medallion as M
from lakesmith.plans import jobs as J
from lakesmith.plans.medallion_queries import PART_DIMENSIONS, PART_ROLES
from lakesmith.plans.tables import table
from lakesmith.session import scratch_path
from lakesmith.sources import tables as ST


def _rows(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), key.alias("key"), value.cast("string").alias("value"))


def _audited(df: DataFrame, name: str, *held: Column) -> DataFrame:
    """One row: how many rows of a table have sound audit columns."""
    sound = held[0]
    for c in held[1:]:
        sound = sound & c
    return _rows(df.agg(F.count_if(sound).alias("n")), "audit", F.lit(name), F.col("n"))


def _recent(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) <= F.current_timestamp()) & (F.col(c) > F.current_timestamp() - F.expr("INTERVAL 1 DAY"))


def q_medallion_tables(spark, d) -> DataFrame:
    """Part reaches bronze in two batches, silver is derived after each (the second run keeps
    the ids of the first), gold is refreshed from the silver table, all with audit columns."""
    bronze_path, silver_path, gold_root = (scratch_path(spark, n) for n in ("job_bronze", "job_silver", "job_gold"))
    part = table(spark, d, "part")
    mid = part.select(F.max("p_partkey") / 2).scalar()
    start: Column | int = 1
    for batch, rows in enumerate((part.where(F.col("p_partkey") <= mid), part.where(F.col("p_partkey") > mid))):
        bronze = M.to_bronze(rows, ["p_partkey"], source_file=F.col("_metadata.file_name"), start_id=start)
        ST.append_batch(bronze, bronze_path, batch)
        start = M.next_id(ST.read_table(spark, bronze_path), M.BRONZE_ID)
        silver = J.run_silver(spark, bronze_path, silver_path, name_candidates=("p_name",), dose_col="p_size", with_timestamps=True)
    paths = J.run_gold(spark, silver_path, gold_root, PART_ROLES, PART_DIMENSIONS,
                       dict(name_col="p_name", check_cols=("p_brand", "p_size", "p_type"), dose_col="p_size", dose_min_col="p_size_min_g"))
    gold = {name: ST.read_table(spark, path) for name, path in paths.items()}
    landed = ST.read_table(spark, bronze_path)
    out = _rows(silver, "silver", F.col("p_name"), F.concat_ws("|", M.SILVER_ID, "row_hash"))
    for part_of in (
            _rows(gold["medicine_catalog"], "medicine_catalog", F.col("medicine_name"), F.concat_ws("|", M.GOLD_ID, "gold_row_hash")),
            _rows(gold["medicine_search"], "medicine_search", F.col("medicine_name"), F.col("search_text")),
            _rows(gold["medicine_stats"], "medicine_stats", F.concat_ws("|", "statistic_name", "dimension_name", "dimension_value"), F.col("record_count")),
            _rows(gold["quality_report"], "quality_report", F.col("metric_name"), F.col("metric_value")),
            _audited(landed, "bronze", _recent("_ingested_at"), F.col("dt_ingest_bronze") == F.col("_ingested_at"),
                     F.col("_ingestion_date") == F.date_format("_ingested_at", "yyyy-MM-dd"), F.col("_source_uri") == F.col("_source_file")),
            _audited(silver, "silver", _recent("silver_processed_at"), _recent("dt_ingest_silver")),
            *[_audited(df, name, _recent("gold_processed_at")) for name, df in gold.items()]):
        out = out.unionByName(part_of)
    return out


def q_conversation_tables(spark, d) -> DataFrame:
    """The three tables that the conversation job writes."""
    store = scratch_path(spark, "conversation_store")
    paths = J.maintain_conversations(table(spark, d, "conversations"), store)
    t = {name: ST.read_table(spark, path) for name, path in paths.items()}
    sessions = _rows(t["chat_sessions"], "chat_sessions", F.concat_ws("|", "conv_id", "username"), F.concat_ws("|", "user_id", "session_key"))
    counters = _rows(t["chat_session_counters"], "chat_session_counters", F.col("user_id").cast("string"), F.col("last_session_number"))
    history = _rows(t["chat_history"], "chat_history", F.concat_ws("|", "conv_id", "turn"), F.md5(F.concat_ws("\n", "user_query", "ai_response")))
    return sessions.unionByName(counters).unionByName(history)


def sql() -> dict[str, str]:
    """DuckDB SQL of both, on top of the SQL of the tables they refresh."""
    from lakesmith.plans.oracle import conversation_sql, medallion_sql
    count = lambda name, source: f"UNION ALL SELECT 'audit', '{name}', CAST(count(*) AS VARCHAR) FROM {source}"
    pairs = conversation_sql()["qa_pairs"]
    return {
        "medallion_tables": f"""{medallion_sql()["gold_job"]}
UNION ALL SELECT 'silver', p_name, concat_ws('|', cd_silver_id, row_hash) FROM silver
{count('bronze', 'part')} {count('silver', 'silver')} {count('medicine_catalog', 'cat')} {count('medicine_search', 'search')}
{count('medicine_stats', 'stats')} {count('quality_report', 'qual')}""",
        "conversation_tables": f"""
WITH s AS (SELECT DISTINCT conv_id, role FROM conversations),
u AS (SELECT role, row_number() OVER (ORDER BY encode(role)) AS user_id FROM (SELECT DISTINCT role FROM s WHERE role IS NOT NULL)),
k AS (SELECT conv_id, role, user_id, row_number() OVER (PARTITION BY role ORDER BY conv_id) AS n FROM s JOIN u USING (role))
SELECT 'chat_sessions' AS table_name, concat_ws('|', conv_id, role) AS key, concat_ws('|', user_id, role || '_' || n) AS value FROM k
UNION ALL SELECT 'chat_session_counters', CAST(user_id AS VARCHAR), CAST(max(n) AS VARCHAR) FROM k GROUP BY user_id
UNION ALL SELECT 'chat_history', concat_ws('|', conv_id, turn), md5(concat_ws(chr(10), user_query, ai_response)) FROM ({pairs})""",
    }
