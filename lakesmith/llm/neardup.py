"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every document is its set of five-word shingles.  Documents of equal sets form one class and are
handled once.  A class has ``trees`` sequences of ``max_depth`` minima; a tree is the trie of its
sorted sequences, and two classes meet in it at depth ``d`` if their first ``d`` minima agree.  The
matched prefix is shortened from ``max_depth`` until a pair at the threshold is met with at least
the target recall, and further while the recall estimated from the links found (each counts
``1 / P(met | its Jaccard)``) is below the target.

A prefix group is linked as a star to its smallest member, so a group of n yields n - 1 edges, and
the connected components of those edges hold every pair that met.  A component is then verified
exactly: its members are dealt into blocks of bounded size and every pair of blocks is one task
group that intersects the shingle sets as a sparse-to-dense product.  A group returns one row per
member (its links and its local component), so no list of pairs exists anywhere; links are exact.

Defined results: null, blank and repeated-word texts: a text without words links to nothing; one of
fewer than ``size`` words has one shingle, all of its words; repeated rows are copies of each other;
documents of null id have null class ids and links that count like all others; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import components, materialise, mix64, shingle_hashes, shingle_sets, text_slices, word_hashes

BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 20


def meet_probability(jaccard: float, depth: int, trees: int) -> float:
    return 1 - (1 - jaccard ** depth) ** trees


def prefix_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix that still meets pairs at the threshold with the target recall."""
    for d in range(max_depth, 1, -1):
        if meet_probability(threshold, d, trees) >= recall:
            return d
    return 1


# --- sketches ------------------------------------------------------------------------------------

def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, trees: int, max_depth: int) -> DataFrame:
    """``(d, th, node, n, sig)`` per row: ``node`` identifies the shingle set (null: no shingle),
    ``sig`` holds the ``trees * max_depth`` minima, four bytes each."""
    n_hash = trees * max_depth
    with np.errstate(over="ignore"):
        salts = (mix64(np.arange(1, n_hash + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                 ).astype(np.uint32) | np.uint32(1)

    def run(batches):
        for b in batches:
            for first, data, offsets in text_slices(b.column(2), 1 << 20):
                sets = list(shingle_sets(data, offsets, size))
                count = np.array([len(s) for s in sets], dtype=np.int64)
                live = np.flatnonzero(count)
                sig = np.zeros((len(live), n_hash), dtype=np.uint32)
                node = np.zeros(len(sets), dtype=np.uint64)
                if len(live):
                    flat = np.concatenate(sets)
                    at = (np.cumsum(count) - count)[live]
                    with np.errstate(over="ignore"):
                        total = np.add.reduceat(mix64(flat), at)
                        node[live] = mix64(total ^ np.bitwise_xor.reduceat(flat, at) ^ mix64(count[live].astype(np.uint64)))
                        low = (flat >> np.uint64(32)).astype(np.uint32)
                        for k, salt in enumerate(salts):
                            x = (low ^ (salt >> np.uint32(7))) * salt
                            x ^= x >> np.uint32(16)
                            x *= np.uint32(0x85EBCA6B)
                            sig[:, k] = np.minimum.reduceat(x, at)
                big = sig.byteswap()  # most significant byte first: binary order is trie order
                sigs: list = [None] * len(sets)
                for i, t in enumerate(live):
                    sigs[t] = big[i].tobytes()
                m = len(sets)
                empty = count == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, m), b.column(1).slice(first, m),
                     pa.array(node.view(np.int64), pa.int64(), mask=empty), pa.array(count, pa.int64()),
                     pa.array(sigs, pa.binary())], names=["d", "th", "node", "n", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"), text_col)
            .mapInArrow(run, f"d {kind}, th long, node long, n long, sig binary"))


# --- forest --------------------------------------------------------------------------------------

def forest_edges(classes: DataFrame, trees: int, max_depth: int, depth: int) -> DataFrame:
    """Star edges of all prefix groups at ``depth``: each member to the smallest of its group."""
    step = 4 * max_depth
    entries = (classes.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("sig"), t * step + 1, F.lit(4 * depth))))
        .alias("tree", "prefix")).select("node", F.xxhash64("tree", "prefix").alias("key")))
    low = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return (entries.join(low.select("key", "low"), "key").where(F.col("node") != F.col("low"))
            .select("node", "low").distinct())


# --- exact verification --------------------------------------------------------------------------

def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sorted sets: only shingles found on both
    sides matter, taken ``width`` columns at a time."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    if not len(both):
        return out
    def coded(sets, flat):
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        own, at = own[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return own[order], at[order]
    (oa, ca), (ob, cb) = coded(a, fa), coded(b, fb)
    for lo in range(0, len(both), width):
        hi = min(lo + width, len(both))
        ma = np.zeros((len(a), hi - lo), dtype=np.float32)
        mb = np.zeros((len(b), hi - lo), dtype=np.float32)
        x, y = np.searchsorted(ca, [lo, hi])
        ma[oa[x:y], ca[x:y] - lo] = 1
        x, y = np.searchsorted(cb, [lo, hi])
        mb[ob[x:y], cb[x:y] - lo] = 1
        out += ma @ mb.T
    return out


def _local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component in a symmetric boolean matrix (label spreading)."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verify(size: int, threshold: float, meet: list[float]):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("kin", pa.int64()), ("weighed", pa.float64()),
                        ("pairs", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        copies = table.column("copies").to_numpy()[order]
        side = table.column("block").to_numpy()[order]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(left) or not len(right):  # the other block is empty: its diagonal pair has all links
            return schema.empty_table()
        sets: list = [None] * len(node)
        text = table.column("text").take(pa.array(order))
        for first, data, offsets in text_slices(text):
            for i, s in enumerate(shingle_sets(data, offsets, size)):
                sets[first + i] = s
        n = np.array([len(s) for s in sets], dtype=np.float32)
        inter = intersections([sets[i] for i in left], [sets[i] for i in right])
        jac = inter / np.maximum(n[left][:, None] + n[right][None, :] - inter, 1)
        linked = jac >= threshold - 1e-6
        one = low == high
        if one:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(node), dtype=np.int64)
        links[left] += linked @ copies[right]
        full = np.zeros((len(node), len(node)), dtype=bool)
        full[np.ix_(left, right)] = linked
        full |= full.T
        if not one:
            links[right] += linked.T @ copies[left]
        kin = node[_local_components(full)]
        # found pairs and the pairs they stand for, noted on the first member
        js = jac[linked] if not one else jac[np.triu(linked)]
        p = np.interp(js, np.linspace(0, 1, len(meet)), meet)
        weighed, pairs = np.zeros(len(node)), np.zeros(len(node), dtype=np.int64)
        weighed[0], pairs[0] = float((1 / np.maximum(p, 1e-9)).sum()), len(js)
        return pa.table([pa.array(node), pa.array(links), pa.array(kin), pa.array(weighed), pa.array(pairs)], schema=schema)
    return run


def verified(candidates: DataFrame, classes: DataFrame, texts: DataFrame, size: int, threshold: float, meet: list[float],
             block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(node, links, kin, weighed, pairs)`` of all block pairs of all candidate components.

    ``candidates``: ``(node, root)`` with the roots listed; ``classes``: ``(node, n, copies, d, th)``;
    ``texts``: ``(d, th, text)``.  A component gets one block per ``block_members`` members and per
    ``block_shingles`` shingles; a member is sent to every pair that its block is in."""
    m = candidates.join(classes.select("node", "n", "copies", "d", "th"), "node")
    blocks = m.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_members),
                                              F.ceil(F.sum("n") / block_shingles)).cast("int").alias("nb"))
    m = m.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    t = texts.withColumnsRenamed({"d": "td", "th": "tth"})
    m = m.join(t, F.col("d").eqNullSafe(F.col("td")) & (F.col("th") == F.col("tth"))).dropDuplicates(["node"])
    m = m.select("root", "node", "copies", "block", "text", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    m = m.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                 "node", "copies", "block", "text")
    return m.groupBy("root", "low", "high").applyInArrow(
        lambda table: _verify(size, threshold, meet)(table),
        "node long, links long, kin long, weighed double, pairs long")


# --- the join ------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
                    trees: int = 20, max_depth: int = 8, recall: float = 0.999, keep_hash: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (smallest id of its connected component of
    links), ``copy_id`` (smallest id among documents of equal shingle sets) and ``n_links`` (other
    documents of Jaccard ``threshold`` or more; copies count each).  With ``keep_hash`` also the
    text's ``__th`` (xxhash64) and the component's ``__root`` (null for texts without words)."""
    rows = materialise(sketch(docs, id_col, text_col, size, trees, max_depth), "sketches")
    have = rows.where(F.col("node").isNotNull())
    groups = have.groupBy("node").agg(F.min("d").alias("copy"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    groups = materialise(groups, "classes")
    # the row that stands for its class: the smallest id's (all rows of a class sketch alike)
    stands = (have.select("node", "d", "th", "sig").join(groups, "node")
              .where(F.col("d").eqNullSafe(F.col("copy"))).dropDuplicates(["node"]))
    classes = materialise(stands.select("node", "n", "copies", "d", "th", "sig"), "class-sketches")
    texts = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    depth = prefix_depth(threshold, trees, max_depth, recall)
    while True:
        spread = components(forest_edges(classes, trees, max_depth, depth), "node", "low")
        members = spread.unionAll(spread.select(F.col("root").alias("node"), "root").distinct())
        meet = [meet_probability(j / 200, depth, trees) for j in range(201)]
        pairs = materialise(verified(members, classes, texts, size, threshold, meet), "verified")
        got = pairs.agg(F.sum("weighed").alias("w"), F.sum("pairs").alias("p")).first()
        if depth == 1 or not got["p"] or got["p"] / got["w"] >= recall:
            break
        depth -= 1
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    kin = components(pairs.select("node", "kin"), "node", "kin")
    named = groups.join(kin, "node", "left").select("node", "copy", "copies", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("copy").alias("class_id"))
    named = (named.join(first, "root").join(links, "node", "left")
             .select("node", "root", "copy", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select("d", "th", F.col("node").alias("rn")).join(named, F.col("rn") == F.col("node"), "left")
    keep = [F.col("th").alias("__th"), F.col("root").alias("__root")] if keep_hash else []
    return out.select(F.col("d").alias(id_col), *keep, F.when(F.col("node").isNull(), F.col("d")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(F.col("node").isNull(), F.col("d")).otherwise(F.col("copy")).alias("copy_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
