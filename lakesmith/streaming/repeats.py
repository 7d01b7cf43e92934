"""Repeats on a stream: query cache (J10) and uniqueness (A16) with expiring state.

A key lives for ``ttl_seconds`` after it was last seen.  A row whose key lives is a *hit* (a cached answer, a
violated uniqueness), any other starts a new life.  State is the time of the last row and the number of rows
of this life, kept per key and dropped by an event-time timer once the watermark has passed its end; whether a
row is a hit depends on event times alone, so any split of the rows into micro-batches gives the same hits, as
long as no batch holds rows older than the watermark (those are dropped, as by any stateful operator).

Only key, time and ids go through the operator.  Keys are dealt by hash into a fixed number of buckets and a
bucket's state holds the lives of all its keys, so Python is called once per bucket and micro-batch, not once
per key, and works on whole columns; keys whose end the watermark has passed leave the state when their bucket
is met again, a bucket without live keys goes by its timer.  The rows of one bucket in one micro-batch meet in
one task; the source's limit per trigger bounds them.  A checkpoint belongs to one number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "keys array<string>, last array<long>, times array<long>"
BUCKETS = 1024
MICROS = 1_000_000


def lives(t: np.ndarray, last: int | np.ndarray | None, times: int | np.ndarray, ttl: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(hit, times)`` of rows at ascending times ``t`` (microseconds), after a life of ``times`` rows that
    was last seen at ``last``.  With ``first`` the rows are those of several keys one after the other: it marks
    the first row of each, and ``last`` and ``times`` have a value per key."""
    at = np.arange(len(t))
    first = at == 0 if first is None else first
    before = np.concatenate([t[:1], t[:-1]])
    before[first] = t[0] - ttl if last is None else last
    hit = t - before < ttl
    begun = at.copy()  # where a row's life begins, if the row opens it; a life from the state began before its key's rows
    begun[first] -= np.where(hit[first], times, 0)
    return hit, at - begun[np.maximum.accumulate(np.where(~hit | first, at, 0))] + 1


def seen_within(stream: DataFrame, key: str, at: str, ids: Sequence[str], ttl_seconds: int, delay: str = "10 minutes",
                buckets: int = BUCKETS) -> DataFrame:
    """``(*ids, key, at, hit, times)`` for every row of a stream (append mode): was its key seen within
    ``ttl_seconds`` before, and the how many-th row of the key's life it is.  Rows of one time go by ``ids``;
    rows of null key or time are left out."""
    columns = [*ids, key, at]
    types = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", hit boolean, times long"
    ttl = ttl_seconds * MICROS
    rows = (stream.select(*columns, F.unix_micros(at).alias("__t"), F.col(key).cast("string").alias("__key"),
                          F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket"))
            .where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["__key", "__t", *ids], kind="stable")
        t, keys = pdf["__t"].to_numpy(dtype=np.int64), pdf["__key"].to_numpy()
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        known = {k: (seen, n) for k, seen, n in zip(*state.get)} if state.exists else {}
        earlier = [known.get(k, (int(begin) - ttl, 0)) for k, begin in zip(keys[first], t[first])]
        hit, nth = lives(t, np.array([x for x, _ in earlier]), np.array([n for _, n in earlier]), ttl, first)
        ends = np.append(np.flatnonzero(first)[1:], len(t)) - 1
        known.update(zip(keys[ends].tolist(), zip(t[ends].tolist(), nth[ends].tolist())))
        since = state.getCurrentWatermarkMs() * 1000 - ttl
        alive = [(k, seen, n) for k, (seen, n) in known.items() if seen >= since]
        state.update(tuple(map(list, zip(*alive))))
        state.setTimeoutTimestamp(max(seen for _, seen, _ in alive) // 1000 + ttl_seconds * 1000 + 1)
        yield pdf[columns].assign(hit=hit, times=nth)

    return rows.groupBy("__bucket").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
