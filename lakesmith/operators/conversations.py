"""Conversation store maintenance (M6) as DataFrame operations.

Per-session ordering uses the skew-safe operators of
:mod:`lakesmith.operators.sequence`: one user or one session may hold a
third of all rows, and a window partitioned by it would put them in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.functions import text as T
from lakesmith.operators.sequence import neighbour, sequence_within, top_k_within

# Default title of a new chat, rolling-memory sizes.
NEW_CHAT_TITLE = "Cuộc trò chuyện mới"
HISTORY_PAIRS = 5
MEMORY_MESSAGES = 20
ALLOWED_RATINGS = (-1, 1)


def qa_pairs(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role",
             text: str = "text", asker: str = "user", answerer: str = "assistant") -> DataFrame:
    """Each ``asker`` turn paired with the turn right after it when that
    one is an ``answerer`` turn (``lead`` via a position self-join)."""
    nxt = neighbour(turns.select(session, order, role, text), [session], [order], [role, text], offset=1, prefix="next_")
    return (nxt.where((F.col(role) == asker) & (F.col(f"next_{role}") == answerer))
            .select(session, order, F.col(text).alias("user_query"), F.col(f"next_{text}").alias("ai_response")))


def last_n(rows: DataFrame, session: str, order: str, n: int = HISTORY_PAIRS) -> DataFrame:
    """K4/K7: the latest ``n`` rows per session, numbered ascending.
    The top-``n`` filter plans a partial ``WindowGroupLimit`` before the
    shuffle, so a long session ships at most ``n`` rows per map task."""
    latest = top_k_within(rows, [session], [F.desc(order)], n, "__desc")
    return latest.withColumn("pos", (F.count(F.lit(1)).over(_w(session)) - F.col("__desc") + 1).cast("long")).drop("__desc")


def _w(session: str):
    from pyspark.sql import Window
    return Window.partitionBy(session)


def unpivot_messages(pairs: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """A (question, answer) row -> a user message row and an assistant row."""
    msgs = F.array(
        F.struct(F.lit(0).alias("msg_no"), F.lit("user").alias("role"), F.col("user_query").alias("text")),
        F.struct(F.lit(1).alias("msg_no"), F.lit("assistant").alias("role"), F.col("ai_response").alias("text")))
    return pairs.select(session, order, F.inline(msgs))


def backfill_session_keys(sessions: DataFrame, users: DataFrame, user_id: str = "user_id",
                          username: str = "username", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Sessions without a key get ``username + '_' + n`` where ``n``
    numbers the user's sessions by (created_at, id)."""
    j = sessions.join(users.select(user_id, username), user_id)
    numbered = sequence_within(j, [user_id], list(order), "__n")
    key = F.concat(F.col(username), F.lit("_"), F.col("__n").cast("string"))
    if "session_key" in sessions.columns:
        key = F.coalesce(F.col("session_key"), key)
    return numbered.withColumn("session_key", key).drop("__n")


def session_number(key: Column, username: Column) -> Column:
    """Numeric suffix of ``username_<n>`` keys, NULL when the key has another shape."""
    prefix_ok = F.substring(key, 1, F.length(username) + 1) == F.concat(username, F.lit("_"))
    suffix = F.substring(key, F.length(username) + 2, F.lit(1 << 30))
    return F.when(prefix_ok & suffix.rlike("^[0-9]+$"), suffix.try_cast("long"))


def number_new_sessions(new: DataFrame, counters: DataFrame | None, user_id: str, order: Sequence[str]) -> DataFrame:
    """New sessions continue their user's counter: ``last + 1, last + 2, …``."""
    base = F.lit(1).cast("long")
    if counters is not None:
        new = new.join(counters.select(user_id, "last_session_number"), user_id, "left")
        base = F.coalesce(F.col("last_session_number"), F.lit(0)) + 1
        new = new.withColumn("__base", base).drop("last_session_number")
        base = F.col("__base")
    out = sequence_within(new, [user_id], list(order), "session_number", start=base)
    return out.drop("__base") if counters is not None else out


def merge_counters(old: DataFrame | None, new_sessions: DataFrame, user_id: str) -> DataFrame:
    """Per-user ``max(session_number)`` upserted into the counters
    with ``greatest`` (full outer join)."""
    cur = new_sessions.groupBy(user_id).agg(F.max("session_number").alias("__new"))
    if old is None:
        return cur.select(user_id, F.col("__new").alias("last_session_number"))
    j = old.join(cur, user_id, "full_outer")
    return j.select(user_id, F.greatest(F.coalesce("last_session_number", F.lit(0)),
                                        F.coalesce("__new", F.lit(0))).cast("long").alias("last_session_number"))


def list_sessions(sessions: DataFrame, user_id: str, id_col: str, order: Sequence[Column]) -> DataFrame:
    """K5: a user's sessions newest first, shown by ``coalesce(session_key, id)``."""
    out = sessions.withColumn("display_key", F.coalesce(F.col("session_key"), F.col(id_col).cast("string")))
    return sequence_within(out, [user_id], list(order), "list_pos")


def delete_sessions(turns: DataFrame, sessions: DataFrame, requests: DataFrame, id_col: str, owner: str) -> DataFrame:
    """U4: remove the turns of sessions named in ``requests`` — only where
    the requester owns the session (the reference skipped that check)."""
    owned = requests.join(sessions.select(id_col, owner), [id_col, owner], "left_semi").select(id_col).distinct()
    return turns.join(owned, id_col, "left_anti")


def rewrite_keys(rows: DataFrame, mapping: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """J7 (UPDATE … FROM): replace ``rows[out]`` by ``mapping[new]`` where
    ``mapping[old]`` equals it; rows without a match keep their value."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new")).where(F.col("__new").isNotNull())
    j = rows.join(m, rows[out] == m["__old"], "left")
    return j.withColumn(out, F.coalesce("__new", F.col(out))).drop("__old", "__new")


def carry_over(turns: DataFrame, session: str, order: str, value: str) -> DataFrame:
    """An empty ``value`` falls back to the previous row's value in the
    session (one step back, as the reference reads the last user message)."""
    prev = neighbour(turns, [session], [order], [value], offset=-1, prefix="prev_")
    empty = F.col(value).isNull() | (F.col(value) == "")
    return prev.withColumn(value, F.when(empty, F.coalesce(F.col(f"prev_{value}"), F.lit(""))).otherwise(F.col(value))) \
        .drop(f"prev_{value}")


def cache_hits(questions: DataFrame, order: Sequence[str], text: str = "text") -> DataFrame:
    """``query_hash = sha256(normalize_text(q))``; a question is a cache
    hit when the same hash was asked earlier (first occurrence = the entry)."""
    h = questions.withColumn("query_hash", F.sha2(T.normalize_text(text), 256))
    first = h.groupBy("query_hash").agg(F.min(F.struct(*order)).alias("__first"))
    j = h.join(first, "query_hash")
    return j.withColumn("hit", F.struct(*order) > F.col("__first")).drop("__first")


def first_turn_titles(turns: DataFrame, session: str, order: str, role: str, text: str,
                      asker: str = "user", max_len: int = 48) -> DataFrame:
    """A session's title from its first user message (``min_by``,
    partial aggregation — no group buffering)."""
    first = turns.where(F.col(role) == asker).groupBy(session).agg(F.min_by(text, order).alias("__first"))
    return first.select(session, T.short_title("__first", max_len).alias("title"))


def update_titles(sessions: DataFrame, updates: DataFrame, session: str, default: str = NEW_CHAT_TITLE) -> DataFrame:
    """Sessions still carrying the default title take the update."""
    j = sessions.join(updates.select(session, F.col("title").alias("__t")), session, "left")
    return j.withColumn("title", F.when(F.col("title") == default, F.coalesce("__t", F.col("title")))
                        .otherwise(F.col("title"))).drop("__t")


def domain_violations(df: DataFrame, table_name: str, key: str, allowed: Mapping[str, Sequence[object]]) -> DataFrame:
    """One row per (row, column) whose value is outside its allowed set."""
    parts = []
    for c, values in allowed.items():
        bad = df.where(F.col(c).isNull() | ~F.col(c).isin(*values))
        parts.append(bad.select(F.lit(table_name).alias("table_name"), F.col(key).cast("long").alias("row_key"),
                                F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_violations(df: DataFrame, key: Column | str) -> DataFrame:
    """Keys that occur more than once (partial aggregation map-side)."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent (``left_anti``)."""
    return child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def rolling_memory(messages: DataFrame, session: str = "conv_id", order: Sequence[str] = ("turn", "msg_no"),
                   n: int = MEMORY_MESSAGES) -> DataFrame:
    """K7: the last ``n`` messages of every session in time order (the
    chatbot's rolling memory), via the partial top-``n`` filter."""
    from pyspark.sql import Window
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    latest = messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return latest.withColumn("pos", (F.count(F.lit(1)).over(Window.partitionBy(session)) - F.col("__r") + 1).cast("long")) \
        .drop("__r")
