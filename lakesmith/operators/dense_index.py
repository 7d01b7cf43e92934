"""Dense search in cells (R2): k-means cells, vectors stored by cell, several cells probed per question.

The cells are fitted on a bounded sample (``sample_rows`` rows in hash order); every vector is indexed, under
its nearest centroid, and scored exactly when its cell is probed.  How many cells a question probes is
measured when the index is built: the exact neighbours of ``tuning_rows`` vectors are looked up in the cells,
and the smallest number of probes that finds ``target`` of them is kept.  On vectors without clusters that
number is a large share of the cells; it is never guessed.  A cell that holds a large share of all
vectors is met in pieces, and a cell that many questions probe in blocks of questions, so a task holds at
most about ``piece_rows`` vectors and ``question_rows`` questions.  The result is approximate only in which
cells are read: :func:`recall` measures it against :func:`lakesmith.operators.retrieval.dense_topk`.

Vectors without a direction (NULL, a NULL or NaN entry, all zero) are not indexed and find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise
from lakesmith.operators.retrieval import SEARCH_K, _usable, dense_topk
from lakesmith.operators.sequence import top_k_within

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
ROUNDS = 12
TUNING_ROWS, TARGET = 200, 0.95


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def first_hashed(rows: DataFrame, hashed: Column, id_col: str, count: int) -> DataFrame:
    """The first ``count`` rows in the order of ``(hashed, id)``, read below a bound on the hash that about
    twice as many rows meet: a plain limit would send ``count`` rows of every partition to the driver."""
    n = rows.count()
    share = 2 * count / n if n else 1.0
    below = rows
    if share < 0.5:
        below = rows.where(hashed < F.lit(int(-2**63 + share * 2**64)))
        if below.count() < count:  # many rows of few ids
            below = rows
    return materialise(below.orderBy(hashed, id_col).limit(count), "sample")


def fit_cells(vectors: DataFrame, id_col: str, vec_col: str, cells: int, sample_rows: int = SAMPLE_ROWS,
              rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means over at most ``sample_rows`` vectors, the first in the order of
    their id's hash; fewer centroids if the sample has fewer distinct vectors."""
    sample = first_hashed(vectors.select(id_col, vec_col), F.xxhash64(id_col), id_col, sample_rows).select(vec_col).toPandas()[vec_col]
    if not len(sample):
        return np.zeros((0, 0))
    points = _unit(np.stack([np.asarray(v, dtype="float64") for v in sample]))
    start = np.unique(points, axis=0)
    centroids = start[np.random.default_rng(seed).permutation(len(start))[:cells]]
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


@dataclass
class DenseIndex:
    """Vectors ``(id, vec)`` at ``path``, one folder per ``cell``; ``sizes (cell, n)`` and the centroids are
    bounded by the number of cells.  ``probes`` is the measured number of cells a question needs."""

    path: str
    centroids: np.ndarray
    sizes: DataFrame
    probes: int = 1

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """All stored vectors, or those of some cells (other folders are not opened)."""
        df = self.sizes.sparkSession.read.parquet(self.path)
        return df if cells is None else df.where(F.col("cell").isin(cells))


def _nearest(centroids, column: str, count: int, keep: list[str]):
    """Per row of ``keep + column`` its ``count`` nearest cells, a row each."""

    def run(batches):
        block = centroids.value
        for pdf in batches:
            if not len(pdf):
                continue
            near = np.argsort(-(_unit(np.stack([np.asarray(v, dtype="float64") for v in pdf[column]])) @ block.T), axis=1, kind="stable")[:, :count]
            out = pdf.loc[np.repeat(pdf.index, near.shape[1]), [*keep, column]].reset_index(drop=True)
            out["cell"] = near.ravel().astype("int32")
            yield out

    return run


def build_dense_index(vectors: DataFrame, path: str, id_col: str, vec_col: str, cells: int | None = None,
                      splits: int = 4, k: int = SEARCH_K, target: float = TARGET, tuning_rows: int = TUNING_ROWS, **fit) -> DenseIndex:
    """Fit the cells, write every usable vector under its cell (at most ``splits`` files a cell and write) and
    measure the probes.  ``cells`` defaults to the square root of the number of vectors, at most ``MAX_CELLS``."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    cells = cells or max(1, min(MAX_CELLS, isqrt(rows.count())))
    centroids = fit_cells(rows, "id", "vec", cells, **fit)
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_CELLS vectors
    placed = rows.mapInPandas(_nearest(shared, "vec", 1, ["id"]), "id long, vec array<double>, cell int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (placed.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(splits))).write.mode("overwrite").partitionBy("cell").parquet(path))
    stored = spark.read.schema("id long, vec array<double>, cell int").parquet(path)
    probes = needed_probes(stored, centroids, k, target, tuning_rows) if len(centroids) > 1 else 1
    return DenseIndex(path, centroids, stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), probes)


def needed_probes(stored: DataFrame, centroids: np.ndarray, k: int = SEARCH_K, target: float = TARGET, tuning_rows: int = TUNING_ROWS) -> int:
    """The smallest number of nearest cells that hold ``target`` of the exact top ``k`` of ``tuning_rows``
    stored vectors (taken in another hash order than the sample of the fit)."""
    asked = first_hashed(stored.select("id", "vec"), F.xxhash64("id", F.lit("tune")), "id", tuning_rows).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = dense_topk(stored, asked, "id", "vec", "query_id", "qvec", k)
    pairs = exact.join(stored.select("id", "cell"), "id").select("query_id", "cell").toPandas()  # at most tuning_rows * k rows
    vectors = asked.toPandas()
    order = np.argsort(-(_unit(np.stack([np.asarray(v, dtype="float64") for v in vectors["qvec"]])) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[pd.Series(range(len(vectors)), index=vectors["query_id"])[pairs["query_id"]].to_numpy(), pairs["cell"].to_numpy()]
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1


def _search(k: int, digits: int):
    def run(stored, asked):
        out = [pd.DataFrame(columns=["query_id", "id", "score"])]
        if len(stored) and len(asked):
            ids = stored["id"].to_numpy(dtype="int64")
            matrix = _unit(np.stack([np.asarray(v, dtype="float64") for v in stored["vec"]]))
            for query_id, vec in zip(asked["query_id"], asked["qvec"]):
                v = np.asarray(vec, dtype="float64")
                score = np.round(matrix @ (v / np.linalg.norm(v)), digits)
                near = score >= np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else np.ones(len(score), dtype=bool)
                names, values = ids[near], score[near]
                order = np.lexsort((names, -values))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "id": names[order], "score": values[order] + 0.0}))
        return pd.concat(out[1:] or out)

    return run


def dense_topk_cells(index: DenseIndex, questions: DataFrame, qid: str, qvec: str, k: int = SEARCH_K, probes: int | None = None,
                     piece_rows: int = 16_384, question_rows: int = 1024, digits: int = 6) -> DataFrame:
    """R2: ``(query_id, id, score, rank)``, the top ``k`` by cosine among the vectors of each question's
    ``probes`` nearest cells (default: the index's measured number).  Vectors and questions of a cell meet in an
    equi-join on (cell, piece, block of questions)."""
    spark = questions.sparkSession
    n_cells = len(index.centroids)
    schema = "query_id long, id long, score double"
    asked = questions.where(_usable(qvec)).select(F.col(qid).cast("long").alias("query_id"), F.col(qvec).cast("array<double>").alias("qvec"))
    if not n_cells:
        return top_k_within(spark.createDataFrame([], schema), ["query_id"], [F.desc("score"), F.asc("id")], k)
    probes = min(n_cells, probes or index.probes)
    shared = spark.sparkContext.broadcast(index.centroids)
    probed = asked.mapInPandas(_nearest(shared, "qvec", probes, ["query_id"]), "query_id long, qvec array<double>, cell int")
    per = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    # a row per probed cell, at most MAX_CELLS: metadata that plans pieces, blocks and the folders to read
    plan = (probed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).join(index.sizes, "cell")
            .select("cell", per("n", piece_rows).alias("pieces"), per("m", question_rows).alias("blocks")).collect())
    cells = F.broadcast(spark.createDataFrame(plan, "cell int, pieces int, blocks int"))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.vectors([r["cell"] for r in plan]).join(cells, "cell").select("id", "vec", "cell", one_of("id", "pieces").alias("piece"), every("blocks").alias("block"))
    right = probed.join(cells, "cell").select("query_id", "qvec", "cell", one_of("query_id", "blocks").alias("block"), every("pieces").alias("piece"))
    keys = ["cell", "piece", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k, digits), schema)
    return top_k_within(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def recall(found: DataFrame, exact: DataFrame, keys: tuple[str, str] = ("query_id", "id")) -> DataFrame:
    """One row ``(questions, wanted, found, recall)``: the share of the exact top ``k`` that was found."""
    hit = found.select(*keys).withColumn("hit", F.lit(1))
    joined = exact.select(*keys).join(hit, list(keys), "left")
    return joined.agg(F.countDistinct(keys[0]).alias("questions"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"),
                      (F.count("hit") / F.count(F.lit(1))).alias("recall"))
