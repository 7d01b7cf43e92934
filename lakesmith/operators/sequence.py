"""Ordered numbering without a single-partition window.

``row_number() over (order by k)`` plans ``Exchange SinglePartition``; with
``partition by g`` it sends a whole group to one task, so a group holding a
third of the rows becomes one straggler.  The operators here range-partition
on ``(group, order)`` instead — a hot group is split across many range
partitions — and stitch the pieces together with a small per-(group,
partition) offsets table:

1. ``repartitionByRange(n, *by, *order)`` + ``sortWithinPartitions``;
   the local index is ``monotonically_increasing_id() - (pid << 33)``.
   An explicit partition count makes the shuffle ``REPARTITION_BY_NUM``,
   which AQE never coalesces, so ``spark_partition_id()`` is stable.
2. ``groupBy(*by, pid)`` gives the first local index and the row count of
   every piece (at most ``#groups + n`` rows).
3. a window over that table (a hot group has at most ``n`` rows there)
   turns counts into offsets, joined back on ``(*by, pid)``.

Both branches must see *one* partitioning: the range partitioner seeds its
key sample with the RDD id, and column pruning gives the two branches
different scans, so two exchanges over the same data may draw different
bounds.  The annotated frame is therefore cut with ``checkpoint()`` into
the shared ``spark.checkpoint.dir`` (reliable storage, survives executor
loss; the checkpoint keeps the range partitioning, so no new shuffle is
needed) and every branch reads that one copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.session import cut_lineage

_PID, _LI, _FIRST, _BEFORE = "__pid", "__li", "__first", "__before"


def _cols(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping one copy of each key."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = term if cond is None else cond & term
    return left.join(r, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by the session."""
    return cut_lineage(df)


def sequence_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    name: str = "seq",
    start: int | Column = 1,
    num_partitions: int | None = None,
) -> DataFrame:
    """Append ``name`` = position of the row inside its ``by`` group.

    Equal to ``row_number() over (partition by by order by order) - 1 + start``
    when ``order`` is a total order within each group.  ``start`` may be a
    column (e.g. a per-group base id carried on the rows).
    """
    by = list(by)
    n = _partitions(df, num_partitions)
    order_cols = _cols(order)
    x = (
        df.repartitionByRange(n, *_cols(by), *order_cols)
        .sortWithinPartitions(*_cols(by), *order_cols)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_LI, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    )
    x = _cut(x)
    pieces = x.groupBy(*by, _PID).agg(F.min(_LI).alias(_FIRST), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*by, _PID, _FIRST, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(_BEFORE))
    if not by:
        # one row per range partition: bounded by n, safe to broadcast
        offsets = F.broadcast(offsets)
    start_col = start if isinstance(start, Column) else F.lit(start)
    out = _join_on_keys(x, offsets, by + [_PID])
    return out.withColumn(
        name, (F.col(_BEFORE) + F.col(_LI) - F.col(_FIRST)).cast("long") + start_col.cast("long")
    ).drop(_PID, _LI, _FIRST, _BEFORE)


def dense_id(df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int | Column = 1,
             num_partitions: int | None = None) -> DataFrame:
    """Global dense surrogate id ``start, start+1, …`` in ``order``."""
    return sequence_within(df, [], order, name=name, start=start, num_partitions=num_partitions)


def cumulative_sum_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    value: str | Column,
    name: str,
    num_partitions: int | None = None,
) -> DataFrame:
    """Running ``sum(value)`` per ``by`` group in ``order`` (inclusive frame).

    Local running sums are computed per (group, range partition) — a bounded
    piece — and shifted by the totals of the earlier pieces of the group.
    """
    by = list(by)
    n = _partitions(df, num_partitions)
    order_cols = _cols(order)
    v = F.col(value) if isinstance(value, str) else value
    x = _cut(df.repartitionByRange(n, *_cols(by), *order_cols)
             .withColumn(_PID, F.spark_partition_id())
             .withColumn("__v", v))
    local_w = Window.partitionBy(*by, _PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = x.withColumn("__local", F.sum("__v").over(local_w))
    totals = x.groupBy(*by, _PID).agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _PID, F.coalesce(F.sum("__t").over(w), F.lit(0)).alias(_BEFORE))
    if not by:
        offsets = F.broadcast(offsets)
    out = _join_on_keys(local, offsets, by + [_PID])
    return out.withColumn(name, F.col("__local") + F.col(_BEFORE)).drop(_PID, "__v", "__local", _BEFORE)


def neighbour(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    columns: Sequence[str],
    offset: int = 1,
    prefix: str = "next_",
    seq_name: str | None = None,
) -> DataFrame:
    """``lead``/``lag`` of ``columns`` (offset > 0 is lead) without a group window.

    Rows are numbered with :func:`sequence_within`, then joined to themselves
    on ``(*by, seq + offset)``: the join key includes the position, so a hot
    group hashes evenly over all reducers.
    """
    by = list(by)
    seq = seq_name or "__seq"
    numbered = sequence_within(df, by, order, name=seq)
    other = numbered.select(
        *[F.col(k).alias(f"__o_{k}") for k in by],
        (F.col(seq) - F.lit(offset)).alias("__o_seq"),
        *[F.col(c).alias(f"{prefix}{c}") for c in columns],
    )
    cond = F.col(seq) == F.col("__o_seq")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    out = numbered.join(other, cond, "left").drop("__o_seq", *[f"__o_{k}" for k in by])
    return out if seq_name else out.drop(seq)


def group_percentile(df: DataFrame, by: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Exact linear-interpolation percentile per group (``percentile`` /
    ``quantile_cont``) without buffering a group's values in one task.

    Values are ranked with :func:`sequence_within`; only the two rows at
    ``floor``/``ceil`` of ``1 + p*(n-1)`` are kept per group.
    """
    by = list(by)
    vals = df.where(F.col(value).isNotNull()).select(*by, value)
    # ties get an arbitrary order so that many equal values still spread over
    # several ranges; any tie order puts the same value at every position
    ranked = sequence_within(vals.withColumn("__tie", F.monotonically_increasing_id()), by, [value, "__tie"],
                             name="__r").drop("__tie")
    counts = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    pos = F.lit(1.0) + F.lit(p) * (F.col("__n") - 1)
    bounds = counts.select(*by, pos.alias("__pos"),
                           F.floor(pos).cast("long").alias("__lo"), F.ceil(pos).cast("long").alias("__hi"))
    picked = _join_on_keys(ranked, bounds, by).where((F.col("__r") == F.col("__lo")) | (F.col("__r") == F.col("__hi")))
    lo_v = F.max(F.when(F.col("__r") == F.col("__lo"), F.col(value)))
    hi_v = F.max(F.when(F.col("__r") == F.col("__hi"), F.col(value)))
    frac = F.max(F.col("__pos") - F.col("__lo"))
    return picked.groupBy(*by).agg((lo_v + (hi_v - lo_v) * frac).alias(name))


def top_k_within(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int,
                 rank_name: str = "rank") -> DataFrame:
    """``row_number() <= k`` per group.  Catalyst plans a partial
    ``WindowGroupLimit`` before the shuffle, so each map task ships at most
    ``k`` rows per group and a hot group cannot overload a reducer."""
    w = Window.partitionBy(*by).orderBy(*_cols(order))
    return df.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= k) \
        .withColumn(rank_name, F.col(rank_name).cast("long"))
