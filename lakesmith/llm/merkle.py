"""Merkle dataset manifest with one octopus multiproof per leaf partition (operator 11).

A row is a leaf; the leaves of one group (a source) ascend by id and form a tree of fan-out three, and
the subroots, ordered by group (null first, UTF-8 bytewise), form the tree above.  The last run of a
level may hold fewer nodes, even one.

* :func:`leaf_rows` hashes the rows in column expressions; from there on only digests move.
* :func:`arrange` range-sorts the leaves by (group, id) and numbers them inside their group.  A *part*
  is a run of at most ``2 ** span_bits`` consecutive leaves, so it may hold the end of one group and
  many small ones, and a hot group is cut into many parts.
* :func:`build` hashes ``depth`` levels at a time in groups of ``3 ** depth`` siblings and stores the
  nodes ``(tree, level, idx, digest)``.
* :func:`prove`: every part works out which nodes its leaves need that neither its leaves nor each
  other yield (the minimal union of missing coordinates), all of them are fetched by one equi-join on
  the coordinates, the shared interior nodes are hashed once in the part, and the single proofs are
  expanded there.

Defined results: null fields hash as ``-``; a null id sorts first; repeated rows and ids are leaves of
their own, ties ordered by leaf digest (equal rows are interchangeable); an empty table has no leaf and
gives no row; other columns, whatever their names, are not read.  Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise, partitions
from lakesmith.operators.sequence import dense_id

FAN = 3
TOP = ""  # the tree over the subroots; the trees of groups are named "-" (null) or "=" and the group
NODE = "tree string, level int, idx long, digest binary"


# --- leaves --------------------------------------------------------------------------------------

def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    text = [c.cast("string") for c in fields]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf_rows(rows: DataFrame, fields: Sequence[str], id_col: str, group_col: str,
              altered: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``(tree, id, leaf, altered)``: a leaf per row, and for rows that satisfy ``where`` the digest of
    the row with the ``altered`` fields in place of its own (else null)."""
    group = F.col(group_col).cast("string")
    changed = F.lit(None).cast("binary")
    if altered:
        hit = F.lit(True) if where is None else where
        changed = F.when(hit, leaf_digest([altered.get(f, F.col(f)) for f in fields]))
    return rows.select(F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"), F.col(id_col).alias("id"),
                       leaf_digest([F.col(f) for f in fields]).alias("leaf"), changed.alias("altered"))


def arrange(leaves: DataFrame, span_bits: int = 9) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``pos`` (0-based, inside the tree) and ``part``, and the trees ``(tree, n)``.

    Rows are range-sorted once and stored with their place; a tree's offset in each range is a row of a
    small table (trees + ranges), so a hot tree is never one task."""
    spark = leaves.sparkSession
    stored = materialise(leaves, "merkle-leaves")  # texts are hashed once, not again for range bounds
    key = ["tree", "id", "leaf"]
    placed = materialise(stored.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
                         .withColumn("place", F.monotonically_increasing_id()), "merkle-places")
    chunk = F.shiftright("place", 33).alias("chunk")
    pieces = materialise(placed.groupBy("tree", chunk).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-pieces")
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    shifts = materialise(pieces.select("tree", "chunk", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "merkle-shifts")
    numbered = (placed.withColumn("chunk", F.shiftright("place", 33)).join(shifts, ["tree", "chunk"])
                .select("tree", "id", "leaf", "altered", (F.col("place") + F.col("shift")).alias("pos"),
                        F.shiftright("place", span_bits).alias("part")))
    return numbered, pieces.groupBy("tree").agg(F.sum("n").alias("n"))


# --- trees ---------------------------------------------------------------------------------------

def _hash(hexes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def _climb(base: int, depth: int):
    """Up to ``depth`` levels over one group of sibling nodes that start at a multiple of 3 ** depth."""

    def run(key, pdf):
        tree, block = key
        pdf = pdf.sort_values("idx")
        nodes = [d.hex().encode() for d in pdf["digest"]]
        sole = block == 0 and len(nodes) < FAN ** depth  # indices are dense: an unfilled first group is the whole level
        first, out = int(block) * FAN ** depth, []
        for k in range(1, depth + 1):
            if sole and len(nodes) == 1:
                break
            nodes = [_hash(nodes[i: i + FAN]) for i in range(0, len(nodes), FAN)]
            out += [(tree, base + k, first // FAN ** k + i, bytes.fromhex(d.decode())) for i, d in enumerate(nodes)]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "digest"])

    return run


def build(level0: DataFrame, depth: int = 5) -> DataFrame:
    """All nodes ``(tree, level, idx, digest)`` over the dense leaves ``(tree, idx, digest)``, level 0
    included.  Each round hashes ``depth`` levels and is written; the number of rounds is the
    logarithm of the largest tree to the base ``3 ** depth``."""
    layer, base = level0.select("tree", F.lit(0).alias("level"), "idx", "digest"), 0
    nodes, group = layer, F.floor(F.col("idx") / F.lit(FAN ** depth)).alias("block")
    while True:
        made = materialise(layer.groupBy("tree", group).applyInPandas(_climb(base, depth), NODE), f"merkle-level-{base}")
        nodes, base = nodes.unionByName(made), base + depth
        layer = made.where(F.col("level") == base)
        if layer.where(F.col("idx") > 0).isEmpty():
            return nodes


def roots(nodes: DataFrame) -> DataFrame:
    """``(tree, digest)``: the highest node of every tree."""
    return nodes.where(F.col("idx") == 0).groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))


@dataclass
class Manifest:
    """``leaves (tree, id, leaf, altered, pos, part)``, ``trees (tree, n, t, subroot)`` with their place
    ``t`` among ``size`` trees, all ``nodes`` and the ``root`` (hex; None of an empty table)."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    size: int
    root: str | None


def manifest(leaves: DataFrame, span_bits: int = 9, depth: int = 5) -> Manifest:
    """Arrange the leaves of :func:`leaf_rows` and build every group's tree and the tree above them."""
    numbered, counts = arrange(leaves, span_bits)
    nodes = build(numbered.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest")), depth)
    ranked = dense_id(counts.join(roots(nodes), "tree"), ["tree"], "t", start=0)
    trees = materialise(ranked.select("tree", "n", "t", F.col("digest").alias("subroot")), "merkle-trees")
    above = build(trees.select(F.lit(TOP).alias("tree"), F.col("t").alias("idx"), F.col("subroot").alias("digest")), depth)
    root = roots(above).select(F.lower(F.hex("digest"))).first()
    return Manifest(numbered, trees, nodes.unionByName(above), trees.count(), root and root[0])


# --- proofs --------------------------------------------------------------------------------------

def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates ``(level, idx)`` that the proofs of the leaves ``known`` of a tree of ``n`` leaves
    need and that do not follow from those leaves or from one another."""
    out, level, known = [], 0, np.unique(known)
    while n > 1:
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(children[children < n], known, assume_unique=True)]
        known, n, level = parents, -(-n // FAN), level + 1
    return out


def _plan(size: int):
    def run(key, pdf):
        rows = [(key[0], tree, level, idx) for tree, n, places in zip(pdf["tree"], pdf["n"], pdf["places"])
                for level, idx in missing(np.asarray(places, dtype=np.int64), int(n))]
        rows += [(key[0], TOP, level, idx) for level, idx in missing(pdf["t"].to_numpy(dtype=np.int64), size)]
        return pd.DataFrame(rows, columns=["part", "tree", "level", "idx"])

    return run


class _Tree:
    """One tree as far as a part knows it: leaves and fetched nodes, interiors hashed on the way up."""

    def __init__(self, leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], n: int):
        self.levels, path = [], sorted(leaves)  # per level: all known nodes
        nodes, level = dict(leaves), 0
        while n > 1:
            nodes.update({i: d for (k, i), d in fetched.items() if k == level})
            self.levels.append((nodes, n))
            path = sorted({i // FAN for i in path})
            nodes = {p: _hash([nodes[i] for i in range(p * FAN, min(p * FAN + FAN, n))]) for p in path}
            n, level = -(-n // FAN), level + 1
        self.root = nodes[path[0]]

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        nodes, n = self.levels[level]
        first = i - i % FAN
        return (b"".join(nodes[j] for j in range(first, i)), b"".join(nodes[j] for j in range(i + 1, min(first + FAN, n))))

    def proofs(self, leaves, above: bytes) -> dict[int, bytes]:
        """The siblings from each leaf to the root, then ``above``; paths that meet share their upper part."""
        wanted = [sorted(set(leaves))]
        for _ in self.levels:
            wanted.append(sorted({i // FAN for i in wanted[-1]}))
        upper = {wanted[-1][0]: above}
        for level in range(len(self.levels) - 1, -1, -1):
            upper = {i: b"".join(self.siblings(level, i)) + upper[i // FAN] for i in wanted[level]}
        return upper

    def fold(self, i: int, digest: bytes) -> bytes:
        """The root that follows from ``digest`` at leaf ``i`` and the original siblings."""
        for level in range(len(self.levels)):
            left, right = self.siblings(level, i)
            digest, i = _hash([left, digest, right]), i // FAN
        return digest


def _expand(size: int, root: str):
    def run(leaves, known):
        got: dict[str, dict[tuple[int, int], bytes]] = {}
        at: dict[str, tuple[int, int, bytes]] = {}
        for tree, level, idx, digest, n, t in zip(known["tree"], known["level"], known["idx"], known["digest"], known["n"], known["t"]):
            hexed = digest.hex().encode()
            if level < 0:
                at[tree] = int(n), int(t), hexed
            else:
                got.setdefault(tree, {})[int(level), int(idx)] = hexed
        trees = {tree: _Tree({int(p): d.hex().encode() for p, d in zip(x["pos"], x["leaf"])}, got.get(tree, {}), at[tree][0])
                 for tree, x in leaves.groupby("tree", sort=False)}
        top = _Tree({at[tree][1]: x.root for tree, x in trees.items()}, got.get(TOP, {}), size)
        above = top.proofs([at[tree][1] for tree in trees], b"")
        frames = []
        for tree, x in leaves.groupby("tree", sort=False):
            mine, (_, t, subroot) = trees[tree], at[tree]
            places = [int(p) for p in x["pos"]]
            proofs = mine.proofs(places, above[t])
            folded = [top.root.decode() if not isinstance(d, bytes) else top.fold(t, mine.fold(p, d.hex().encode())).decode()
                      for p, d in zip(places, x["altered"])]
            frames.append(pd.DataFrame({
                "id": x["id"].array, "leaf": [d.hex() for d in x["leaf"]], "subroot": subroot.decode(), "root": root,
                "proof_sha256": [hashlib.sha256(proofs[p]).hexdigest() for p in places], "folded_root": folded,
                "verified": [f == root for f in folded]}))
        return pd.concat(frames) if frames else pd.DataFrame(columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def missing_nodes(m: Manifest, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(runs, coordinates)`` of the leaves ``wanted``: each part's trees, and the minimal union of the
    node coordinates ``(part, tree, level, idx)`` that it has to fetch."""
    runs = wanted.groupBy("part", "tree").agg(F.collect_list("pos").alias("places")).join(m.trees, "tree")
    return runs, runs.groupBy("part").applyInPandas(_plan(m.size), "part long, tree string, level int, idx long")


def prove(m: Manifest, where: Column | None = None) -> DataFrame:
    """The proofs of all leaves (or of those that satisfy ``where``): ``(id, leaf, subroot, root,
    proof_sha256, folded_root, verified)``.  ``proof_sha256`` hashes the siblings from the leaf over the
    subroot to the root, ``folded_root`` follows from the leaf (the altered one, if any) and those
    siblings, ``verified`` tells whether it is the manifest's root."""
    wanted = m.leaves if where is None else m.leaves.where(where)
    id_type = wanted.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if m.root is None:
        return wanted.sparkSession.createDataFrame([], schema)
    runs, coordinates = missing_nodes(m, wanted)
    none = F.lit(None).cast("long")
    fetched = coordinates.join(m.nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest", none.alias("n"), none.alias("t"))
    known = fetched.unionByName(runs.select("part", "tree", F.lit(-1).alias("level"), none.alias("idx"), F.col("subroot").alias("digest"), "n", "t"))
    return wanted.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(_expand(m.size, m.root), schema)
