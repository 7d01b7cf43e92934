"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (1 to 3 letters, word edges included), weighted
``(1 + log tf) * idf`` and scaled to length one.  Every language has several centroids, found by
spherical k-means; a text gets the language of the centroid of largest cosine, and that cosine is
its score.  A text farther from its centroid than the outermost share of that centroid's own
training texts is ``rejected``.

Document frequencies cover all training texts.  The centroids are fitted on a bounded, documented
sample: the ``fit_rows`` texts of each language with the smallest id hash.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first
language in order; null languages are not learnt; repeated rows are scored alike; without training
texts every text is ``und``; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise

UNKNOWN = "und"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20  # letters counted at a time, so that a very long text needs no long arrays


def ngram_counts(text: str | None, bits: int) -> np.ndarray | None:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text; None without a letter."""
    if not text:
        return None
    clean = " " + _NOT_LETTER.sub(" ", text.lower()) + " "
    if not any(c.isalpha() for c in clean):
        return None
    out = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint32(32 - bits)
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(codes), _PIECE):
            c = codes[a: a + _PIECE + 2]
            last = a + _PIECE + 2 >= len(codes)
            c1 = c * np.uint32(2654435761)
            two = c1[:-1] ^ (c[1:] * np.uint32(2246822519) + np.uint32(97))
            three = (two[:-1] * np.uint32(3266489917)) ^ (c[2:] * np.uint32(668265263) + np.uint32(193))
            stop = len(c) if last else _PIECE
            for h in (c1 * np.uint32(374761393), two * np.uint32(2654435769), three * np.uint32(2654435769)):
                h = h[:stop]
                h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
                out += np.bincount(h >> shift, minlength=1 << bits)
            if last:
                break
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(counts))
    hit = counts > 0
    v[hit] = (1 + np.log(counts[hit])) * idf[hit]
    return v / max(np.linalg.norm(v), 1e-12)


def document_frequencies(texts: DataFrame, text_col: str, bits: int) -> tuple[np.ndarray, int]:
    """How many texts hold each hashed n-gram: one partial vector per task, summed by Spark."""
    def count(batches):
        total, n = np.zeros(1 << bits, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = ngram_counts(t.as_py(), bits)
                if c is not None:
                    total += c > 0
                    n += 1
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int64)),
                                          pa.array(np.append(total[hit], n).astype(np.int64))], names=["i", "n"])
    got = (texts.select(text_col).mapInArrow(count, "i long, n long")
           .groupBy("i").agg(F.sum("n").alias("n")).collect())  # at most 2**bits + 1 rows
    df, n = np.zeros(1 << bits, dtype=np.int64), 0
    for r in got:
        if r["i"] < 0:
            n = int(r["n"])
        else:
            df[r["i"]] = r["n"]
    return df, n


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; seeds are chosen farthest-first from the mean, so reruns agree."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin(np.max(x @ np.stack(seeds).T, axis=1))])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


@dataclass(frozen=True)
class Centroids:
    bits: int
    idf: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    matrix: np.ndarray
    floor: np.ndarray  # least cosine that is not rejected, of each centroid

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        c = ngram_counts(text, self.bits)
        if c is None or not self.langs:
            return UNKNOWN, 0.0, True
        sim = self.matrix @ vector(c, self.idf)
        best = int(np.argmax(sim))
        return self.langs[best], float(min(max(sim[best], 0.0), 1.0)), bool(sim[best] < self.floor[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        usable: Column | None = None, bits: int = 12, centroids: int = 4, fit_rows: int = 400,
        reject_share: float = 0.01) -> Centroids:
    """Learn every language of the rows for which ``usable`` holds.  Each is fitted in a task of its
    own on at most ``fit_rows`` distinct rows; only centroids reach the driver.  The frequencies of n-grams
    come from every usable row."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    df, n = document_frequencies(rows, text_col, bits)
    shared = spark.sparkContext.broadcast(np.log((n + 1) / (df + 1)) + 1)
    # a row is known by the hash of its id and text: any type of id, and repeated rows count once
    keyed = rows.select(F.col(lang_col).alias("l"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("t"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("k"))
    chosen = materialise(keyed.select("l", "k").distinct().withColumn("r", first).where(F.col("r") <= fit_rows).select("l", "k"), "language-sample")
    sample = keyed.join(chosen, ["l", "k"])

    def sparse(batches):  # n-gram counts, not texts, are shuffled: bounded by 2**bits a text
        for b in batches:
            out = []
            for lang, k, t in zip(*(b.column(j).to_pylist() for j in range(3))):
                c = ngram_counts(t, bits)
                if c is not None:
                    hit = np.flatnonzero(c)
                    out.append({"l": lang, "k": k, "at": hit.tolist(), "n": c[hit].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("l", pa.string()), ("k", pa.int64()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    def learn(table: pa.Table) -> pa.Table:
        idf, own = shared.value, []
        for r in sorted(table.to_pylist(), key=lambda r: r["k"]):
            c = np.zeros(1 << bits, dtype=np.int64)
            c[r["at"]] = r["n"]
            own.append(vector(c, idf))
        x = np.stack(own)
        m = spherical_kmeans(x, centroids)
        sim = x @ m.T
        near = np.argmax(sim, axis=1)
        floors = [float(np.quantile(sim[near == j, j], reject_share)) if (near == j).any() else 1.0 for j in range(len(m))]
        lang = table.column("l")[0].as_py()
        return pa.table([pa.array([lang] * len(m)), pa.array(range(len(m)), pa.int32()), pa.array(floors, pa.float64()),
                         pa.array([c.astype("<f8").tobytes() for c in m], pa.binary())], names=["l", "j", "floor", "c"])
    got = (sample.mapInArrow(sparse, "l string, k long, at array<long>, n array<long>")
           .groupBy("l", "k").agg(F.first("at").alias("at"), F.first("n").alias("n"))  # equal rows have equal counts
           .groupBy("l").applyInArrow(learn, "l string, j int, floor double, c binary").collect())
    got = sorted(got, key=lambda r: (r["l"], r["j"]))
    matrix = np.stack([np.frombuffer(r["c"], "<f8") for r in got]) if got else np.zeros((0, 1 << bits))
    return Centroids(bits, shared.value, tuple(r["l"] for r in got), matrix, np.array([r["floor"] for r in got]))


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, rejected)`` for every row.  The model is bounded by
    languages x centroids x 2**bits numbers and travels with the task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bits, model.idf, model.langs, model.matrix, model.floor))

    def run(batches):
        m = Centroids(*shared.value)
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
            .withColumnRenamed("id", id_col))
