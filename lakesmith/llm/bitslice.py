"""Exact top-k inner products on a bit-sliced index (operator 12).

Vectors are quantised to integers and stored by *blocks* of rows: for every component, one bitmap over the
block's rows per binary digit of (value - the component's minimum in the block).  A question turns its own
components into signed binary digits (at most every second one is non-zero); every digit ``±2**b`` of
component ``d`` adds ``d``'s slices, ``b`` places up, to the score's slices.  A negative digit adds the
complements, which differs from subtraction by a constant of the question and block.  All bitmaps of one
binary place are added three to two by full adders, so the score of all rows of a block comes out as
bitmaps too (:func:`score_slices`).

The best ``k`` rows are then taken from the most significant slice downward (:func:`select_top`): rows
with the digit set stay while there are at least ``k`` of them.  The rows tied at the end are resolved
exactly, by smaller id.  A task keeps each question's best ``k`` over its blocks, and a last ranking merges
them.

Index and questions meet in pairs of (group of blocks, block of questions), both bounded in rows; the
question blocks come from a table, so none passes through the driver.

Defined results: vectors that are null or hold a null or non-finite component, and rows of null id, take no
part, neither do they ask; of vectors of different lengths the missing components count as zero; repeated
ids and rows are rows of their own (a question leaves out its own row only); an empty table gives no row;
a question with fewer than ``k`` candidates returns them all.  A component whose integer has 31 bits or
more raises an error, as scores might not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise
from lakesmith.operators.sequence import dense_id, top_k_within

LIMIT = float(1 << 30)


def quantise(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, values)``: the integers ``floor(scale * x)``, computed in doubles, of all usable vectors."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)), dtype=np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))  # a null component is a NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = np.asarray(vectors.is_valid()) & (bad[ends] == bad[np.concatenate([[0], ends[:-1]]).astype(np.int64)])
            of_kept = np.repeat(keep, np.diff(ends, prepend=0))
            if np.abs(x[of_kept]).max(initial=0) >= LIMIT:
                raise ValueError("a component is too large to be indexed")
            offsets = np.concatenate([[0], np.cumsum(np.diff(ends, prepend=0)[keep])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[of_kept].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), values], names=["id", "values"])

    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("values")).where("id IS NOT NULL")
    return usable.mapInArrow(run, "id long, values array<int>")


# --- the index -----------------------------------------------------------------------------------

def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(low, slices)`` of the integer matrix rows x components: each component's minimum, and bitmaps of
    shape (components, digits, words of 64 rows)."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    digits = max(int(above.max(initial=0)).bit_length(), 1)
    n, d = above.shape
    padded = np.zeros((-(-n // 64) * 64, d), dtype=np.uint64)
    padded[:n] = above
    out = np.empty((d, digits, len(padded) // 64), dtype=np.uint64)
    for s in range(digits):
        bits = ((padded >> np.uint64(s)) & np.uint64(1)).astype(np.uint8).T
        out[:, s, :] = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)
    return low, out


def _slice(key, rows):
    """One block of the index from its rows."""
    rows = rows.sort_values("place")
    low, slices = slice_block(_padded(rows["values"], max(1, *map(len, rows["values"]))))
    return pd.DataFrame([(key[0], rows["id"].to_numpy(dtype=np.int64).tobytes(), low.tobytes(), slices.shape[1], slices.tobytes())],
                        columns=["block", "ids", "low", "digits", "slices"])


def build_index(placed: DataFrame, block_bits: int = 13) -> DataFrame:
    """The stored index of the rows ``(place, id, values)``, numbered without gaps in the order of id: a row
    per block of ``2 ** block_bits`` consecutive rows."""
    block = F.shiftright("place", block_bits).alias("block")
    return materialise(placed.groupBy(block).applyInPandas(_slice, "block long, ids binary, low binary, digits int, slices binary"), "sliced-index")


# --- scores and selection ------------------------------------------------------------------------

def signed_digits(values: np.ndarray) -> np.ndarray:
    """Rows ``(component, place, negative)`` of the non-zero digits of the integers in signed binary form,
    no two neighbours of which are non-zero."""
    out = []
    for d, v in enumerate(values.tolist()):
        a, place = abs(v), 0
        while a:
            if a & 1:
                digit = 2 - (a & 3)
                out.append((d, place, (digit < 0) != (v < 0)))
                a -= digit
            a, place = a >> 1, place + 1
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def planes(slices: np.ndarray) -> np.ndarray:
    """A block's bitmaps and their complements, as rows."""
    flat = slices.reshape(-1, slices.shape[2])
    return np.concatenate([flat, ~flat])


def schedule(question: np.ndarray, digits: int) -> list[np.ndarray]:
    """Per binary place of the scores, the planes that the question adds there.  It holds for all blocks of
    that many components and digits."""
    size = len(question) * digits
    component, place, minus = signed_digits(question).T
    start = minus * size + component * digits - place
    return [start[(place <= w) & (w < place + digits)] + w for w in range(int(place.max(initial=0)) + digits)]


def score_slices(plan: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    """Bitmaps of the scores of all rows of a block less their offset: places x words, the least significant
    first.  All bitmaps of a place are summed in one buffer, their carries go into the next place's."""
    words, most = flat.shape[1], 2 * max(map(len, plan), default=0) + 2
    here, after, half, both = (np.empty((most, words), dtype=np.uint64) for _ in range(4))
    out, carried, w = [], 0, 0
    while w < len(plan) or carried:
        m, carries = carried, 0
        if w < len(plan) and len(plan[w]):
            np.take(flat, plan[w], axis=0, out=here[m: m + len(plan[w])], mode="clip")
            m += len(plan[w])
        while m > 1:  # full adders: three bitmaps of this place become one, and one of the next
            k = m // 3
            if k:
                x, y, z, h, c = here[:k], here[k: 2 * k], here[2 * k: 3 * k], half[:k], both[:k]
                np.bitwise_xor(x, y, out=h)
                np.bitwise_and(x, y, out=c)
                np.bitwise_and(h, z, out=x)
                np.bitwise_or(c, x, out=after[carries: carries + k])
                np.bitwise_xor(h, z, out=x)
                here[k: m - 2 * k] = here[3 * k: m]
                m -= 2 * k
            else:
                k, m = 1, 1
                np.bitwise_and(here[0], here[1], out=after[carries])
                here[0] ^= here[1]
            carries += k
        out.append(here[0].copy() if m else np.zeros(words, dtype=np.uint64))
        here, after, carried, w = after, here, carries, w + 1
    return np.stack(out) if out else np.zeros((1, words), dtype=np.uint64)


def negatives(question: np.ndarray) -> int:
    """The sum of the places of the question's negative digits."""
    _, place, minus = signed_digits(question).T
    return sum(1 << p for p in place[minus == 1].tolist())


def offset(question: np.ndarray, low: np.ndarray, digits: int, negative: int) -> int:
    """What a score is above its bitmaps: the components' minima, and the complements of negative digits."""
    return int(question @ low) - ((1 << digits) - 1) * negative


def _count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _rows(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def select_top(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The rows of ``among`` (a bitmap) with the ``k`` highest scores, from the most significant slice
    downward.  Rows that share the boundary score are taken in row order, which is id order."""
    sure, tied = np.zeros_like(among), among
    if _count(among) <= k:
        return _rows(among)
    for s in scores[::-1]:
        ones = tied & s
        n = _count(sure) + _count(ones)
        if n >= k:
            tied = ones
        else:
            sure, tied = sure | ones, tied & ~s
        if n == k:
            return _rows(sure | tied)
    return np.concatenate([_rows(sure), _rows(tied)[: k - _count(sure)]])


def scores_of(rows: np.ndarray, scores: np.ndarray, offset: int) -> np.ndarray:
    """The exact scores of some rows, read from their bits."""
    bits = (scores[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
    total = np.zeros(len(rows), dtype=np.uint64)
    for s in range(len(scores) - 1, -1, -1):
        total = (total << np.uint64(1)) | bits[s]
    return total.astype(np.int64) + offset


# --- search --------------------------------------------------------------------------------------

def _padded(vectors: Iterable, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: min(width, len(v))] = v[:width]
    return out


def _search(k: int, block_bits: int):
    def run(index, asked):
        blocks = []
        for b in index.sort_values("block").itertuples():
            ids, low = np.frombuffer(b.ids, dtype=np.int64), np.frombuffer(b.low, dtype=np.int64)
            flat = planes(np.frombuffer(b.slices, dtype=np.uint64).reshape(len(low), b.digits, -1))
            everyone = np.packbits(np.arange(flat.shape[1] * 64) < len(ids), bitorder="little").view(np.uint64)
            blocks.append((b.block, ids, low, b.digits, flat, everyone))
        found = [pd.DataFrame(columns=["place", "query_id", "vec_id", "score"])]
        for place, query_id, values in zip(asked["place"], asked["id"], asked["values"]):
            own, row = place >> block_bits, place & ((1 << block_bits) - 1)
            plans, held, names = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
            for block, ids, low, digits, flat, among in blocks:
                if (len(low), digits) not in plans:
                    question = _padded([values], len(low))[0]
                    plans[len(low), digits] = question, schedule(question, digits), negatives(question)
                question, plan, negative = plans[len(low), digits]
                if block == own:  # all rows but the question's own
                    among = among.copy()
                    among[row // 64] &= ~np.uint64(1 << (row % 64))
                sums = score_slices(plan, flat)
                rows = select_top(sums, among, k)
                held = np.concatenate([held, scores_of(rows, sums, offset(question, low, digits, negative))])
                names = np.concatenate([names, ids[rows]])
                order = np.lexsort((names, -held))[:k]
                held, names = held[order], names[order]
            found.append(pd.DataFrame({"place": place, "query_id": query_id, "vec_id": names, "score": held}))
        return pd.concat(found[1:] or found)

    return run


def top_k(rows: DataFrame, asks: Column, k: int = 10, block_bits: int = 13, group_bits: int = 17, most_questions: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of every row ``(id, values)`` whose id satisfies ``asks``, the
    ``k`` other rows with the highest inner products, ties to the smaller id.

    A task holds the index of at most ``2 ** group_bits`` rows and at most ``most_questions`` questions;
    fewer questions where that leaves cores idle (the results do not depend on it)."""
    spark = rows.sparkSession
    placed = dense_id(materialise(rows.select("id", "values"), "sliced-rows"), ["id", "values"], "place", start=0)
    asked = dense_id(placed.where(asks).select("place", "id", "values"), ["place"], "no", start=0)
    n, questions = placed.count(), asked.count()
    if not n or not questions:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = ((n - 1) >> group_bits) + 1
    per_task = min(most_questions, max(32, questions * groups // (4 * spark.sparkContext.defaultParallelism)))
    index = build_index(placed, block_bits).withColumn("group", F.shiftright("block", group_bits - block_bits))
    index = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit((questions - 1) // per_task))))
    asked = asked.select("place", "id", "values", F.floor(F.col("no") / per_task).cast("int").alias("ask"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    found = index.groupBy("group", "ask").cogroup(asked.groupBy("group", "ask")).applyInPandas(
        _search(k, block_bits), "place long, query_id long, vec_id long, score long")
    best = top_k_within(found, ["place"], [F.desc("score"), F.asc("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
