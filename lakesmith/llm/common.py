"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.session import checkpoint_root, scratch_path

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


# --- Columns -------------------------------------------------------------------------------------

def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text as an array (null or blank text: empty)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN))


def bind(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row.  A plain column would be inlined into
    every lambda that mentions it and so evaluated once per array element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds`` (a null key falls in no fold: null)."""
    return F.crc32(key.cast("string")) % folds


# --- written intermediates -----------------------------------------------------------------------

def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: the lineage ends
    there, and a lost executor costs a re-read, not a re-computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_filter(keys: DataFrame, key: str, log_bits: int = 26) -> DataFrame:
    """A bitmap over ``key`` (long) as rows ``(bucket, bits)``: ``2 ** log_bits`` bits, 8 MB by
    default whatever the number of keys, so it is safe to broadcast."""
    at = F.pmod(F.col(key), F.lit(1 << log_bits)) + 1
    return (keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def may_contain(rows: DataFrame, key: Column, bitmap: DataFrame, out: str, log_bits: int = 26) -> DataFrame:
    """Append ``out``: false where ``key`` is certainly none of the bitmap's keys.  As the bitmap
    fills, more rows pass; an exact join must follow."""
    at = F.pmod(key, F.lit(1 << log_bits)) + 1
    x = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).withColumn("__bit", F.bitmap_bit_position(at))
    x = x.join(F.broadcast(bitmap.withColumnsRenamed({"bucket": "__bucket", "bits": "__bits"})), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)).cast("int") % 2) == 1
    return x.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__bucket", "__bit", "__bits")


# --- connected components ------------------------------------------------------------------------

def components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for every node with an edge to another node, the root being the
    smallest node of its component (roots themselves are not listed).  Every round is two
    map-side-combined minima and two equi-joins over the edge list; nothing is collected.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col("u") != F.col("v")).distinct())

    def mark(x: DataFrame):
        r = x.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.unionAll(low2.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- vectorised words and shingles (inside Arrow tasks) ------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the public SplitMix generator (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED_CONST = np.uint64(0xD1B54A32D192ED03)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, data bytes, offsets) slices of an Arrow string column, each of about ``limit``
    bytes (one longer text forms a slice of its own); null texts are empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a slice, and the word range of each text
    (``ranges[i]:ranges[i+1]``).  A wrapping polynomial over the bytes, by prefix sums."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a word never crosses two texts
    word = ~blank
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_BASE_INV, n)[starts]
        h = mix64(h ^ ((ends - starts).astype(np.uint64) * _SEED_CONST))
    return h, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size``-word window that starts at every word (the last ``size - 1`` starts,
    and windows that cross texts, are the caller's to leave out)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    m = len(h) - size + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(m, dtype=np.uint64)
        for j in range(size):
            acc = acc * np.uint64(0x100000001B3) + h[j: j + m]
            acc ^= acc >> np.uint64(29)
        return mix64(acc)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Sorted distinct shingle hashes of every text of a slice.  A text of fewer than ``size``
    words has one shingle of all its words, or none if it has no word."""
    h, ranges = word_hashes(data, offsets)
    s = shingle_hashes(h, size)
    for i in range(len(offsets) - 1):
        a, b = ranges[i], ranges[i + 1]
        if b - a >= size:
            yield np.unique(s[a: b - size + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                acc = np.uint64(b - a)
                for x in h[a:b]:
                    acc = (acc ^ x) * np.uint64(0x100000001B3)
                yield mix64(np.array([acc], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
