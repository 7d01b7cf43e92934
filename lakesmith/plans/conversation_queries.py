"""Conversation-store queries on the driver tables: ``conversations``
(conv_id = session, role ``user``/``assistant``/``system``) is the chat
history, each role acts as a user account owning the conversations it
speaks in, ``events`` are session creations per ``user_id``, ``labels``
(quality 1/0 -> rating +1/-1) is the feedback on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.functions import text as T
from lakesmith.operators import conversations as CV
from lakesmith.operators import retrieval as R
from lakesmith.operators.sequence import dense_id, sequence_within
from lakesmith.plans.retrieval_queries import herb_lexicon
from lakesmith.plans.tables import table

EVENT_BATCH_CUT = "2024-01-16"
ALLOWED_EVENT_TYPES = ("view", "click", "signup", "purchase")


def conv(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


def pairs(spark, d) -> DataFrame:
    return CV.qa_pairs(conv(spark, d))


def sessions_with_keys(spark, d) -> DataFrame:
    c = conv(spark, d)
    sessions = c.select("conv_id", "role").distinct()
    users = dense_id(sessions.select("role").distinct(), ["role"], "user_id").withColumnRenamed("role", "username")
    s = sessions.join(users, sessions["role"] == users["username"]).select("conv_id", "user_id")
    return CV.backfill_session_keys(s, users, order=["conv_id"])


def q_qa_pairs(spark, d):
    return pairs(spark, d)


def q_history_last_n(spark, d):
    return CV.last_n(pairs(spark, d), "conv_id", "turn", CV.HISTORY_PAIRS).select("conv_id", "turn", "pos")


def q_messages_unpivot(spark, d):
    return CV.unpivot_messages(pairs(spark, d))


def q_session_backfill(spark, d):
    return sessions_with_keys(spark, d).select("conv_id", F.col("username").alias("role"), "session_key")


def q_session_counters(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "user_id")
    cut = F.lit(EVENT_BATCH_CUT).cast("timestamp")
    first = CV.number_new_sessions(ev.where(F.col("ts") < cut), None, "user_id", ["ts", "event_id"])
    counters = CV.merge_counters(None, first, "user_id")
    second = CV.number_new_sessions(ev.where(F.col("ts") >= cut), counters, "user_id", ["ts", "event_id"])
    return CV.merge_counters(counters, second, "user_id")


def q_session_list(spark, d):
    c = conv(spark, d)
    sessions = c.select("conv_id", "role").distinct()
    keys = sessions_with_keys(spark, d).select("conv_id", F.col("username").alias("role"), "session_key")
    s = sessions.join(keys, ["conv_id", "role"], "left")
    return CV.list_sessions(s, "role", "conv_id", [F.desc("conv_id")]).select("role", "conv_id", "display_key", "list_pos")


def q_session_delete(spark, d):
    c = conv(spark, d)
    owners = c.where(F.col("role") == "user").select("conv_id", F.col("role").alias("owner")).distinct()
    requests = c.where(F.col("role") == "system").select("conv_id", F.lit("user").alias("owner")).distinct()
    return CV.delete_sessions(c.select("conv_id", "turn"), owners, requests, "conv_id", "owner")


def q_key_rewrite(spark, d):
    hist = pairs(spark, d).select("conv_id", "turn", F.col("conv_id").cast("string").alias("session_id"))
    keys = sessions_with_keys(spark, d).where(F.col("username") == "user") \
        .select(F.col("conv_id").cast("string").alias("old_id"), "session_key")
    return CV.rewrite_keys(hist, keys, "old_id", "session_key", "session_id")


def q_short_title(spark, d):
    return conv(spark, d).select("conv_id", "turn", T.short_title("text").alias("title"))


def q_entity_carryover(spark, d):
    users = conv(spark, d).where(F.col("role") == "user") \
        .withColumn("turn_uid", F.concat_ws(":", "conv_id", "turn"))
    tags = R.entity_tags(users, "turn_uid", "text", herb_lexicon(spark, d), default=None) \
        .select("turn_uid", F.col("tags").alias("entities"))
    t = users.join(tags, "turn_uid").select("conv_id", "turn", "entities")
    return CV.carry_over(t, "conv_id", "turn", "entities")


def q_cache_lookup(spark, d):
    users = conv(spark, d).where(F.col("role") == "user").select("conv_id", "turn", "text")
    return CV.cache_hits(users, ["conv_id", "turn"]).select("conv_id", "turn", "query_hash", "hit")


def q_feedback_stats(spark, d):
    lab = table(spark, d, "labels")
    rated = lab.withColumn("rating", F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1)) \
        .where(F.col("rating").isin(*CV.ALLOWED_RATINGS))
    j = rated.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_feedback"),
                                   F.sum("rating").cast("long").alias("sum_rating"),
                                   F.round(F.avg("rating"), 6).alias("avg_rating"))


def q_title_from_first_turn(spark, d):
    return CV.first_turn_titles(conv(spark, d), "conv_id", "turn", "role", "text")


def q_title_update(spark, d):
    c = conv(spark, d)
    custom = CV.first_turn_titles(c, "conv_id", "turn", "role", "text", asker="system") \
        .withColumnRenamed("title", "custom")
    sessions = c.select("conv_id").distinct().join(custom, "conv_id", "left") \
        .select("conv_id", F.coalesce("custom", F.lit(CV.NEW_CHAT_TITLE)).alias("title"))
    return CV.update_titles(sessions, CV.first_turn_titles(c, "conv_id", "turn", "role", "text"), "conv_id")


def q_domain_violations(spark, d):
    lab = CV.domain_violations(table(spark, d, "labels"), "labels", "doc_id", {"quality": (0, 1), "toxic": (0, 1)})
    ev = CV.domain_violations(table(spark, d, "events"), "events", "event_id", {"event_type": ALLOWED_EVENT_TYPES})
    return lab.unionByName(ev)


def q_feedback_orphans(spark, d):
    return CV.orphans(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", "doc_id")


def q_greeting_route(spark, d):
    return conv(spark, d).select("conv_id", "turn", F.when(T.is_greeting("text"), F.lit("greeting"))
                                 .otherwise(F.lit("retrieval")).alias("route"))


def q_entity_prefix_clean(spark, d):
    return conv(spark, d).where(F.col("role") == "user") \
        .select("conv_id", "turn", T.clean_disease_entity("text").alias("entity"))


def q_session_messages(spark, d):
    return sequence_within(conv(spark, d).select("conv_id", "turn"), ["conv_id"], ["turn"], "pos")


def q_conversation_job(spark, d):
    """Sessions (backfilled keys) and counters are written to the
    store, read back, and summarised per user with the turn counts."""
    from lakesmith.session import scratch_path
    from lakesmith.sources.tables import read_table, write_overwrite

    keyed = sessions_with_keys(spark, d)
    sessions_path = write_overwrite(keyed.select("conv_id", "user_id", "username", "session_key"),
                                    scratch_path(spark, "chat_sessions"))
    sessions = read_table(spark, sessions_path)
    counters = sessions.groupBy("user_id", "username").agg(
        F.max(CV.session_number(F.col("session_key"), F.col("username"))).alias("last_session_number"),
        F.count(F.lit(1)).alias("n_sessions"))
    counters_path = write_overwrite(counters, scratch_path(spark, "chat_session_counters"))
    turns = conv(spark, d).groupBy(F.col("role").alias("username")).agg(F.count(F.lit(1)).alias("n_turns"))
    return read_table(spark, counters_path).join(turns, "username") \
        .select("username", "n_sessions", "last_session_number", "n_turns")
