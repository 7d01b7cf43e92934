"""Stateful stream queries: tables are written as drops in time order, every drop is streamed through the same
query and checkpoint, and the result is what all micro-batches appended.  The DuckDB SQL beside each query
states the result without any batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.functions import text as T
from lakesmith.plans.tables import table
from lakesmith.session import scratch_path
from lakesmith.sources import tables as ST
from lakesmith.streaming.ingest import _run
from lakesmith.streaming.repeats import seen_within

START = 1_704_067_200  # conversations begin a minute apart from here
CACHE_SECONDS = 120
UNIQUE_SECONDS = 86_400


def streamed(spark: SparkSession, rows: DataFrame, drops: Sequence[Column], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``rows`` that arrive in drops (a condition each), every drop in a run of its own."""
    landing, out, ck = (scratch_path(spark, n) for n in ("drops", "stream_out", "stream_ckpt"))
    schema = rows.schema
    for drop in drops:
        rows.where(drop).write.mode("append").parquet(landing)
        _run(step(spark.readStream.schema(schema).parquet(landing)), ck, lambda batch, i: ST.append_batch(batch, out, i))
    return ST.read_table(spark, out).drop(ST.BATCH_COL)


def q_cache_stream(spark, d) -> DataFrame:
    """User questions are asked again one and five minutes later; an answer is cached for two minutes
    after it was last asked for.  Three drops in time order."""
    users = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    asked = users.select("conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(5))).alias("again"), "text")
    asked = asked.select("conv_id", "turn", "again", F.sha2(T.normalize_text("text"), 256).alias("query_hash"),
                         F.timestamp_seconds(START + (F.col("conv_id") + F.col("again")) * 60 + F.col("turn")).alias("asked_at"))
    since = F.unix_seconds("asked_at") - START
    end = asked.agg(F.max(since)).first()[0] or 0
    third = F.floor(since * 3 / F.lit(end + 1))
    got = streamed(spark, asked, [third == i for i in range(3)],
                   lambda s: seen_within(s, "query_hash", "asked_at", ["conv_id", "turn", "again"], CACHE_SECONDS))
    return got.select("conv_id", "turn", "again", "query_hash", "hit", "times")


def q_unique_stream(spark, d) -> DataFrame:
    """Events of one user and type within a day of the one before, found while they stream in by
    thirds of the month."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                                              F.concat_ws(":", "user_id", "event_type").alias("key"))
    day = F.dayofmonth("ts")
    got = streamed(spark, events, [day <= 10, (day > 10) & (day <= 20), day > 20],
                   lambda s: seen_within(s, "key", "ts", ["event_id"], UNIQUE_SECONDS))
    return got.where("hit").select("event_id", "key", "times")


SQL = {
    "cache_stream": r"""
WITH a AS (SELECT conv_id, turn, again, sha256({norm}) AS query_hash, (conv_id + again) * 60 + turn AS s
           FROM (SELECT *, unnest([0, 1, 5]) AS again FROM conversations WHERE role = 'user')),
h AS (SELECT *, coalesce(s - lag(s) OVER w < 120, false) AS hit FROM a WINDOW w AS (PARTITION BY query_hash ORDER BY s, conv_id, turn, again)),
l AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY query_hash ORDER BY s, conv_id, turn, again ROWS UNBOUNDED PRECEDING) AS life FROM h)
SELECT conv_id, turn, again, query_hash, hit, row_number() OVER (PARTITION BY query_hash, life ORDER BY s, conv_id, turn, again) AS times FROM l""",
    "unique_stream": """
WITH a AS (SELECT event_id, concat_ws(':', user_id, event_type) AS key, epoch_us(ts) AS t FROM events),
h AS (SELECT *, coalesce(t - lag(t) OVER w < 86400000000, false) AS hit FROM a WINDOW w AS (PARTITION BY key ORDER BY t, event_id)),
l AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS life FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY key, life ORDER BY t, event_id) AS times FROM l)
SELECT event_id, key, times FROM n WHERE hit""",
}
