"""Interaction audit of document filters over every order of applying them (operator 13).

A document is the *mask* of the filters that it fails, so all orders can be counted from the mask counts.
In an order, it is removed at the first filter of its mask; the orders in which that is the ``s``-th
filter ``f`` share a prefix of ``s`` filters (the first ``s - 1`` outside the mask, the last ``f``), and
the orders of one prefix are consecutive in lexicographic order: an interval of ``(k - s)!`` Lehmer
ranks.  So every mask adds its counts at the start of its intervals and takes them off behind their end,
and a prefix sum over the ranks gives what each order removes at each step (:func:`removals`).

Everything is column expressions and keyed aggregates: one pass over the texts, a row a document of
narrow columns, then tables of parts x masks and parts x steps x ranks.

Defined results: null texts are empty (and equal to empty texts); a null part counts as the empty string;
a document is a copy if a strictly smaller id holds an identical text, so rows of null id and rows that
repeat an id are no copies of each other; several label rows of an id count as one (the mark if any row
has it), those of null id as none; a null mark is none; an empty table has no part and gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.llm.common import bind, materialise, words

# The names and conditions of the five audited filters.
FILTERS = "ABCDE"
DUPLICATE = "E"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, CODE_SIGNS = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("n", "good", "toxic")


# --- what every document fails -------------------------------------------------------------------

def bit(f: str, filters: str = FILTERS) -> int:
    return 1 << filters.index(f)


def text_mask(text: Column) -> Column:
    """The filters that read one text alone and that it fails."""
    n = lambda w: F.size(w).cast("long")
    flag = lambda failed, f: F.when(failed, bit(f)).otherwise(0)
    capitals = (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long")
    by_words = bind(words(text), lambda w: flag(n(w) < MIN_WORDS, "A") + flag(100 * n(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * n(w), "B"))
    return by_words + flag(100 * capitals > MAX_CAPITAL_PERCENT * F.length(text).cast("long"), "C") + flag(text.rlike(CODE_SIGNS), "D")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents of a part fail exactly the filters of a mask.

    Texts are read once; the copies are found from the smallest id of every digest, met on (digest, id),
    so a text that a third of all documents share is spread by its ids."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                                   F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")), "audit-rows")
    first = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    seen = rows.join(first, ["digest", "id"], "left").join(marks, "id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return (seen.groupBy("part", (F.col("mask") + F.when(copy, bit(DUPLICATE)).otherwise(0)).alias("mask"))
            .agg(F.count(F.lit(1)).alias("n"), total("good").alias("good"), total("toxic").alias("toxic")))


# --- orders --------------------------------------------------------------------------------------

def lehmer_rank(order: str, filters: str) -> int:
    """Place of an order among all orders in lexicographic order, from its Lehmer code."""
    k = len(filters)
    return sum(sum(g < f for g in order[i + 1:]) * factorial(k - 1 - i) for i, f in enumerate(order))


def intervals(filters: str = FILTERS) -> list[tuple[int, int, str, int, int]]:
    """``(mask, step, filter, start, end)``: the ranks ``start <= r < end`` of the orders in which a document
    of that mask is removed at that step, by that filter."""
    k, out = len(filters), []
    for size in range(1, k + 1):
        for mask in combinations(filters, size):
            bits, passed = sum(bit(f, filters) for f in mask), [f for f in filters if f not in mask]
            for step in range(1, len(passed) + 2):
                for before in permutations(passed, step - 1):
                    for f in mask:
                        prefix = "".join(before) + f
                        start = lehmer_rank(prefix + "".join(sorted(set(filters) - set(prefix))), filters)
                        out.append((bits, step, f, start, start + factorial(k - step)))
    return out


def removals(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, filter, n, good, toxic)``: what each step of every order removes, zeros
    included.  Differences at the interval ends are summed per (part, step, rank); the prefix sum runs over
    the ranks of one part and step (``k!`` rows, whatever the number of documents)."""
    spark, k = counts.sparkSession, len(filters)
    ends = [(mask, step, rank, sign) for mask, step, _, start, end in intervals(filters)
            for rank, sign in ((start, 1), (end, -1)) if rank < factorial(k)]
    # the intervals of all masks: a fixed table of a few hundred rows
    marks = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))
    orders = F.broadcast(spark.createDataFrame(
        [(lehmer_rank("".join(p), filters), s + 1, "".join(p), p[s]) for p in permutations(filters) for s in range(k)],
        "rank int, step int, filter_order string, filter string"))
    changes = (counts.join(marks, "mask").groupBy("part", "step", "rank")
               .agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS]))
    grid = counts.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))).alias("rank"))
    upto = Window.partitionBy("part", "step").orderBy("rank")
    summed = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "step", "rank", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in COUNTS])
    return summed.join(orders, ["step", "rank"]).select("part", "filter_order", "step", "filter", *COUNTS)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of all orders from :func:`masks`: per part, order and step what is kept, removed,
    redundant, failed uniquely and lost, and the filter's removals summed over all orders."""
    counts = materialise(counts, "audit-masks")
    gone = removals(counts, filters)
    fails = lambda f: F.expr(f"mask & {bit(f, filters)}") != 0
    only = lambda f: F.col("mask") == bit(f, filters)
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.struct(F.lit(f).alias("filter"), F.coalesce(F.sum(F.when(fails(f), F.col("n"))), F.lit(0)).alias("failing"),
                           F.coalesce(F.sum(F.when(only(f), F.col("n"))), F.lit(0)).alias("unique_fails")) for f in filters]).alias("each"))
    per_filter = totals.select("part", "total", F.inline("each"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    everywhere = Window.partitionBy("part", "filter")
    return gone.join(per_filter, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(everywhere).alias("shapley"))
