"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are to be found inside long documents.  A MinHash of a whole long document says
nothing about a short item in it, so both sides are partitioned by size: an item of ``n`` shingles
belongs to the partition ``u`` (the power of two with ``u/2 < n <= u``), and for each partition in
use a document is seen as windows of ``2u`` shingles with step ``u``.  Any run of ``u`` shingles lies
in one window whole, so the containment bound ``t`` becomes a Jaccard bound of the pair
(item, window) that does not depend on the document's length, and the number of hash functions is
chosen per partition to reach the target recall.  Window minima are computed once on blocks and
merged upwards from partition to partition.

A window that agrees with an item in any of its minima is a candidate; candidates are verified by
exact containment of the item's distinct shingles in the whole document.  Items are taken in blocks
of bounded size (a broadcast each); every block meets all documents in one narrow pass, nothing is
shuffled.

An item of fewer than ``size`` words is one shingle of all its words.  Such items are looked up among the
documents' windows of their own number of words (``short_items``); an item of a word or two is part of many
clean texts, so a filter may leave them out.

Defined results: null and blank texts match nothing, neither does a document with fewer words than the item's
shingles have; repeated rows and equal items are all reported, items
of null id with a null ``item``; an empty table on either side gives no match; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakesmith.llm.common import materialise, mix64, shingle_hashes, text_slices, word_hashes
from lakesmith.operators.sequence import cumulative_sum_within

BLOCK_SHINGLES = 1 << 20


def jaccard_bound(threshold: float, u: int) -> float:
    """Least Jaccard of an item of partition ``u`` and the window that holds its run."""
    q = u // 2 + 1
    return threshold * q / (2 * u + q - threshold * q)


def functions_needed(threshold: float, u: int, recall: float) -> int:
    """Hash functions for which a pair at the bound agrees in at least one minimum."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard_bound(threshold, u)))


def _salts(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hash(s: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = s * salt
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class ItemIndex:
    """Minima of a block of items ``(id, words of a shingle, shingles)`` by partition; its attributes are
    plain arrays and dictionaries, and only those travel to the tasks."""

    def __init__(self, items: list[tuple[object, int, np.ndarray]], size: int, threshold: float, recall: float) -> None:
        self.threshold = threshold
        self.sets = [s for _, _, s in items]
        self.ids = [i for i, _, _ in items]
        by: dict[int, list[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}  # by words and hash, the items of one shingle
        for k, (_, words, s) in enumerate(items):
            if words < size:
                self.short.setdefault(words, {}).setdefault(int(s[0]), []).append(k)
                continue
            by.setdefault(1 << max(0, (len(s) - 1).bit_length()), []).append(k)
        self.need = {u: functions_needed(threshold, u, recall) for u in by}
        self.salts = _salts(max(self.need.values(), default=0))
        self.minima: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u, ks in by.items():
            for f in range(self.need[u]):
                v = np.array([_hash(self.sets[k], self.salts[f]).min() for k in ks], dtype=np.uint64)
                order = np.argsort(v, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[(v >> np.uint64(48)).astype(np.int64)] = True
                self.minima[u, f] = (v[order], np.array(ks)[order], seen)

    def candidates(self, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs among the texts of a slice; text ``i`` has shingles
        ``s[starts[i]:ends[i]]``."""
        found: set[tuple[int, int]] = set()
        live = np.flatnonzero(ends > starts)
        if not len(live) or not self.need:
            return found
        smallest = min(self.need)
        # blocks of the smallest partition in use never cross texts
        per = -(-(ends[live] - starts[live]) // smallest)
        owner0 = np.repeat(live, per)
        first = np.cumsum(per) - per
        at0 = np.repeat(starts[live], per) + (np.arange(per.sum()) - np.repeat(first, per)) * smallest
        pieces = np.concatenate([s[a:b] for a, b in zip(starts[live], ends[live])])
        moved = np.cumsum(ends[live] - starts[live]) - (ends[live] - starts[live])
        at = at0 - np.repeat(starts[live], per) + np.repeat(moved, per)
        for f, salt in enumerate(self.salts):
            low, owner, u = np.minimum.reduceat(_hash(pieces, salt), at), owner0, smallest
            while True:
                if f < self.need.get(u, 0):
                    pair = low.copy()  # a window: a block and the next one of the same text
                    same = owner[:-1] == owner[1:]
                    pair[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                    values, ks, seen = self.minima[u, f]
                    hit = np.flatnonzero(seen[(pair >> np.uint64(48)).astype(np.int64)])
                    if len(hit):
                        a, b = np.searchsorted(values, pair[hit], "left"), np.searchsorted(values, pair[hit], "right")
                        for h, x, y in zip(hit[b > a], a[b > a], b[b > a]):
                            found.update((int(owner[h]), int(k)) for k in ks[x:y])
                if u >= max(self.need):
                    break
                # merge blocks two by two inside each text
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                rank = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
                even = np.flatnonzero(rank % 2 == 0)
                low, owner, u = np.minimum.reduceat(low, even), owner[even], u * 2
        return found


def restored(attributes: dict) -> ItemIndex:
    x = ItemIndex.__new__(ItemIndex)
    vars(x).update(attributes)
    return x


def shingled(texts: DataFrame, id_col: str, text_col: str, size: int, short: bool) -> DataFrame:
    """``(id, w, n, s)``: the distinct shingles of ``w`` words of texts that have any; ``w`` is ``size``, or
    all words of a shorter text if ``short``."""
    def run(batches):
        for b in batches:
            for first, data, offsets in text_slices(b.column(1)):
                h, r = word_hashes(data, offsets)
                s = shingle_hashes(h, size)
                rows = []
                for i in range(len(offsets) - 1):
                    n = int(r[i + 1] - r[i])
                    if n >= size or (short and n):
                        own = np.unique(s[r[i]: r[i + 1] - size + 1] if n >= size else shingle_hashes(h[r[i]: r[i + 1]], n))
                        rows.append({"id": b.column(0)[first + i].as_py(), "w": min(n, size), "n": len(own), "s": own.view(np.int64).tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("id", b.schema.field(0).type), ("w", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, w long, n long, s array<long>")


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8,
               recall: float = 0.9995, block_shingles: int = BLOCK_SHINGLES, short_items: bool = True) -> DataFrame:
    """``(id, item, shared, item_shingles)``: every document and item of which at least
    ``threshold`` of the distinct shingles occur in the document."""
    spark = docs.sparkSession
    it = materialise(shingled(items, item_id_col, item_text_col, size, short_items), "items")
    # every row carries its own block: null ids and equal items need no join
    sized = cumulative_sum_within(it.withColumn("k", F.xxhash64("w", "s")), [], ["id", "k"], "n", "__cum")
    it = materialise(sized.select("id", "w", "s", F.floor((F.col("__cum") - F.col("n")) / block_shingles).alias("block")), "item-blocks")
    top = it.agg(F.max("block")).first()[0]
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((docs, id_col), (items, item_id_col)))
    schema = f"id {kind}, item {item_kind}, shared long, item_shingles long"
    out = spark.createDataFrame([], schema)
    for block in range(0 if top is None else top + 1):
        rows = it.where(F.col("block") == block).select("id", "w", "s").collect()  # bounded by block_shingles and one item
        items_of = sorted(((r["id"], r["w"], np.array(r["s"], dtype=np.int64).view(np.uint64)) for r in rows), key=lambda x: (str(x[0]), len(x[2])))
        index = spark.sparkContext.broadcast(vars(ItemIndex(items_of, size, threshold, recall)))
        part = docs.select(id_col, text_col).mapInArrow(_matcher(index, size, threshold, to_arrow_type(it.schema["id"].dataType)), schema)
        out = out.unionAll(part)
    return out


def _matcher(index, size: int, threshold: float, item_type: pa.DataType):
    def run(batches):
        x = restored(index.value)
        for b in batches:
            for first, data, offsets in text_slices(b.column(1)):
                h, r = word_hashes(data, offsets)
                s = shingle_hashes(h, size)
                starts = r[:-1]
                ends = np.maximum(np.minimum(r[1:] - size + 1, len(s)), starts)
                rows: dict[str, list] = {"id": [], "item": [], "shared": [], "item_shingles": []}
                own, of = np.zeros(0, np.uint64), -1
                for t, k in sorted(x.candidates(s, starts, ends)):
                    if t != of:
                        own, of = np.unique(s[starts[t]: ends[t]]), t
                    item = x.sets[k]
                    shared = int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())
                    if shared >= threshold * len(item) - 1e-9:
                        rows["id"].append(b.column(0)[first + t].as_py())
                        rows["item"].append(x.ids[k])
                        rows["shared"].append(shared)
                        rows["item_shingles"].append(len(item))
                for n, wanted in x.short.items():
                    own = shingle_hashes(h, n)
                    own_starts = np.arange(len(own))
                    of = np.searchsorted(r, own_starts, side="right") - 1  # the text of a window, which must end in it
                    at = np.flatnonzero(np.isin(own, np.fromiter(wanted, np.uint64)) & (own_starts + n <= r[of + 1]))
                    for t, v in sorted({(int(of[j]), int(own[j])) for j in at}):
                        for k in wanted[v]:
                            for name, value in zip(rows, (b.column(0)[first + t].as_py(), x.ids[k], 1, 1)):
                                rows[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["id"], b.schema.field(0).type), pa.array(rows["item"], item_type),
                     pa.array(rows["shared"], pa.int64()), pa.array(rows["item_shingles"], pa.int64())], names=list(rows))
    return run
