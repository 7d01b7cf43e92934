"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight that changes over training time ``t`` in [0, 1] (a piecewise-linear
schedule).  The integral of the schedule is the source's cumulative token demand; inverting it
turns a document's cumulative token offset inside its source into the training position at which
the document is due.  Documents are then range-sorted by position.

Sizes are counted in words.  Nothing is collected: the per-source table stays a DataFrame, and the
running totals of a source come from range-partitioned pieces, so one source may hold any share of
the rows.

Defined results: null or blank text has size 0 and is never repeated beyond its source's rate;
a null source is a source of its own, last in order; a null id is an ordinary document; repeated
rows are separate documents; documents of equal order key are taken in an arbitrary but equal-sized
order; an empty table gives an empty table.  Columns of the input are kept, the new ones carry the
names given by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise, words
from lakesmith.operators.sequence import cumulative_sum_within

Schedule = Sequence[tuple[float, float]]

#: Weight over training time: rising, level and falling; the integral of each is 1.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def invert_schedule(u: Column, schedule: Schedule) -> Column:
    """The time ``t`` at which the share ``u`` of the schedule's whole integral has been spent."""
    spent, area = [0.0], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if not (t1 > t0 and min(w0, w1) >= 0):
            raise ValueError("a schedule needs rising times and weights of 0 or more")
        area += (t1 - t0) * (w0 + w1) / 2
        spent.append(area)
    if not area > 0:
        raise ValueError("a schedule needs a positive integral")
    out = F.lit(float(schedule[-1][0]))
    for i in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
        y = F.greatest(u * area - spent[i], F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + y * (2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        t = F.least(F.when(root + w0 > 0, F.lit(t0) + y * 2.0 / (root + w0)).otherwise(F.lit(t0)), F.lit(t1))
        out = F.when(u * area <= spent[i + 1], t).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """Targets from a per-source table ``(__src, __total)``.

    The sources, ordered by code point with null last, take the weights in turn and share the whole
    of all sizes; no target exceeds ``max_repeats`` times its source.  What lies above is shared
    again by weight until none is above: with sources ordered by cap per weight, the capped ones
    are a prefix, so one ordered pass over this table finds the common level.
    """
    by_name = Window.orderBy(F.col("__src").asc_nulls_last())
    by_level = Window.orderBy("__level", "__rank")
    s = (sizes.withColumn("__rank", F.row_number().over(by_name) - 1)
         .withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                         (F.col("__rank") % len(weights) + 1).cast("int")))
         .withColumn("__cap", F.col("__total") * float(max_repeats))
         .withColumn("__level", F.col("__cap") / F.col("__w"))
         .withColumn("__all", F.sum("__total").over(Window.rowsBetween(Window.unboundedPreceding,
                                                                       Window.unboundedFollowing)))
         .withColumn("__below", F.coalesce(F.sum("__cap").over(
             by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("__above", F.sum("__w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("__share", (F.col("__all") - F.col("__below")) / F.col("__above")))
    open_ = F.when(F.col("__level") > F.col("__share"), F.col("__share"))
    s = s.withColumn("__share", F.first(open_, ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("__src", "__rank", "__total",
                    F.coalesce(F.least(F.col("__cap"), F.col("__share") * F.col("__w")),
                               F.col("__cap")).alias("__target"))


def assign_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     source_col: str = "source", weights: Sequence[float] = (1, 2, 3),
                     max_repeats: int = 3, schedules: Sequence[Schedule] = SCHEDULES,
                     seed: str = "mix") -> DataFrame:
    """One row per document: ``__id, __src, __size, __source_size, __target, __copies`` and
    ``__positions``, the training position of each copy (narrow: the text is not carried).

    A source whose target is ``r`` times its size gives every document ``floor(r)`` times and the
    first ``r - floor(r)`` of its words, in a fixed pseudo-random order, once more.
    """
    narrow = materialise(docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__src"),
        F.size(words(F.col(text_col))).cast("long").alias("__size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
        .alias("__key")), "mix-sizes")  # texts are split into words once
    running = cumulative_sum_within(narrow, ["__src"], ["__key", "__id", "__size"], "__size", "__cum")
    targets = source_targets(narrow.groupBy("__src").agg(F.sum("__size").alias("__total")), weights, max_repeats)
    # one row per source; joined by the source's hash so that a hot source may be split by the optimiser
    t = targets.select(F.col("__src").alias("__s"), "__rank", "__total", "__target")
    x = running.join(t, F.col("__src").eqNullSafe(F.col("__s")), "left").drop("__s")
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    middle = F.col("__cum") - F.col("__size") / F.lit(2.0)
    extra = F.when((F.col("__size") > 0) & (middle < (rate - whole) * F.col("__total")), 1).otherwise(0)
    x = x.withColumn("__copies", (whole + extra).cast("int"))
    offset = lambda e: F.least((middle + e * F.col("__total")) / F.col("__target"), F.lit(1.0))
    kind = F.col("__rank") % len(schedules)
    def due(e):
        out = None
        for k, s in enumerate(schedules):
            t_ = invert_schedule(offset(e), s)
            out = F.when(kind == k, t_) if out is None else out.when(kind == k, t_)
        return out
    copies = F.slice(F.array(*[F.lit(i) for i in range(max_repeats)]), F.lit(1), F.col("__copies"))
    return x.select("__id", "__src", "__size", F.col("__total").alias("__source_size"), "__target", "__copies",
                    F.transform(copies, due).alias("__positions"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               epoch_name: str = "epoch", position_name: str = "position", **kw) -> DataFrame:
    """The training sequence: one row per taken copy with all columns of ``docs``, ``epoch_name``
    and ``position_name``, range-sorted by position.  Documents taken no time are left out; columns of
    ``docs`` that bear one of the two names give way to them."""
    plan = assign_positions(docs, id_col, text_col, source_col, **kw)
    # rows of one id may repeat: number the copies of a key on both sides, so that none is lost
    due = (plan.where(F.col("__copies") > 0)
           .select(F.struct(F.col("__id").alias("i"), F.col("__src").alias("s"), F.col("__size").alias("n")).alias("__k"),
                   F.posexplode("__positions").alias("__epoch", "__position"))
           .groupBy("__k", "__epoch").agg(F.sort_array(F.collect_list("__position")).alias("__at")))
    keyed = docs.withColumn("__k", F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"),
                                            F.size(words(F.col(text_col))).cast("long").alias("n")))
    twin = Window.partitionBy("__k").orderBy(F.xxhash64(F.col(text_col)))
    keyed = keyed.withColumn("__nth", F.row_number().over(twin))
    out = (keyed.join(due, "__k").where(F.col("__nth") <= F.size("__at"))
           .select(*[F.col(f"`{c}`") for c in docs.columns if c not in (epoch_name, position_name)], F.col("__epoch").alias(epoch_name),
                   F.element_at(F.col("__at"), F.col("__nth")).alias(position_name)))
    return out.orderBy(position_name, id_col)
