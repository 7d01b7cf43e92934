"""BM25 top-k with block bounds.

Documents are numbered by (their most frequent token, length, id) and cut into blocks of neighbours, which
so share a language or a subject and a length; a row of the stored index is one token of one block with its postings and the largest weight among them, the
*bound*.  The sum of a question's bounds in a block limits the score of every document there, so

1. bounds are summed per (question, block) — the postings themselves are not opened;
2. the few blocks of the highest limits are scored: their k-th score is the question's threshold;
3. of the other blocks only those whose limit reaches the threshold are opened, and there at first only
   the question's rarer tokens: a document that holds none of them cannot reach the threshold, because the
   bounds of the common ones add up to less;
4. the common tokens are opened in blocks where a document's sum so far, plus their bounds, still reaches it.

(question, document) rows exist only for opened blocks, and the result equals the full sum: whatever is
skipped scores less than k documents that are already known.  The more alike the documents of a block are,
the tighter are its bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesmith.operators.retrieval import SEARCH_K, _bm25_weight, _text_index, bounded
from lakesmith.operators.sequence import dense_id, top_k_within
from lakesmith.session import cut_lineage, scratch_path

BLOCK_DOCS = 8
SEED_BLOCKS = 16


def build_block_index(docs: DataFrame, name: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                      block_docs: int = BLOCK_DOCS, buckets: int | None = None) -> DataFrame:
    """Write table ``name`` at ``path``: ``(block, tok, bound, n, postings)``, bucketed by block.  A posting
    is ``(doc_id, weight)``; a row holds at most ``block_docs`` of them."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch_path(spark, "block-postings")
    _text_index(docs, id_col, text_col, n).write.parquet(stored)
    counts = spark.read.parquet(stored)
    features = counts.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), F.max_by("tok", F.struct("tf", "tok")).alias("top"))
    placed = dense_id(features, ["top", "doc_len", "doc_id"], "no", start=0)
    block = F.floor(F.col("no") / F.lit(block_docs)).alias("block")
    rows = counts.withColumn("weight", _bm25_weight()).join(placed.select("doc_id", block), "doc_id")
    (rows.repartition(n, "block").groupBy("block", "tok")
     .agg(F.max("weight").alias("bound"), F.count(F.lit(1)).alias("n"),
          F.collect_list(F.struct("doc_id", "weight")).alias("postings"))
     .write.bucketBy(n, "block").sortBy("block", "tok").option("path", path).mode("overwrite").saveAsTable(name))
    return spark.table(name)


@dataclass
class PrunedSearch:
    """``hits (query_id, doc_id, score, rank)`` and, per question, ``work (query_id, postings, postings_read,
    blocks, blocks_read)``: how many postings and blocks hold its tokens, and how many were opened."""

    hits: DataFrame
    work: DataFrame


def _sums(rows: DataFrame) -> DataFrame:
    """Sums per (question, block, document); the block in the key keeps them inside the index's buckets."""
    return rows.groupBy("query_id", "block", "doc_id").agg(F.sum("weight").alias("weight"))


def _opened(index: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """The index rows of the questions' tokens in the chosen ``(query_id, block)``."""
    return index.join(bounded(terms), "tok").join(bounded(blocks.select("query_id", "block").distinct()), ["query_id", "block"], "left_semi")


def _rare_first(index: DataFrame, terms: DataFrame, thresholds: DataFrame, spare: float) -> DataFrame:
    """``(query_id, tok, rare)``: from a question's commonest token on, tokens are not rare as long as their
    largest weights together stay below its threshold.  One row per token of a question."""
    lists = index.join(bounded(terms.select("tok").distinct()), "tok", "left_semi").groupBy("tok").agg(F.max("bound").alias("top"), F.sum("n").alias("df"))
    common_first = Window.partitionBy("query_id").orderBy(F.desc("df"), "tok").rowsBetween(Window.unboundedPreceding, 0)
    together = F.round(F.sum("top").over(common_first), 9)
    return (terms.join(lists, "tok").join(thresholds, "query_id", "left")
            .select("query_id", "tok", F.coalesce(together + spare >= F.col("threshold"), F.lit(True)).alias("rare")))


def bm25_topk_pruned(index: DataFrame, terms: DataFrame, k: int = SEARCH_K, seed_blocks: int = SEED_BLOCKS,
                     digits: int = 6) -> PrunedSearch:
    """Top ``k`` documents per question by (score desc, doc_id), the rows of ``bm25_topk``.

    ``terms`` is ``(query_id, tok)``.  A question without a known token has no row; one with fewer than
    ``k`` documents in its seed blocks has no threshold and opens all its blocks."""
    spare = 10.0 ** -digits  # limits and scores are sums in different orders, and scores are rounded
    order = [F.desc("score"), F.asc("doc_id")]
    score = F.round("weight", digits).alias("score")
    terms = bounded(terms.select("query_id", "tok").distinct())
    limits = cut_lineage(index.select("block", "tok", "bound", "n").join(terms, "tok").groupBy("query_id", "block")
                         .agg(F.round(F.sum("bound"), 9).alias("limit"), F.sum("n").alias("n")))
    seeds = top_k_within(limits, ["query_id"], [F.desc("limit"), F.asc("block")], seed_blocks).select("query_id", "block")
    first = _sums(_opened(index, terms, seeds).select("query_id", "block", F.inline("postings")))
    best = cut_lineage(top_k_within(first.select("query_id", "doc_id", score), ["query_id"], order, k))
    thresholds = bounded(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("threshold"))
                         .where(F.col("found") >= k).select("query_id", "threshold"))
    reaches = lambda limit: F.coalesce(limit + spare >= F.col("threshold"), F.lit(True))
    rated = cut_lineage(limits.join(seeds.withColumn("seed", F.lit(True)), ["query_id", "block"], "left").join(thresholds, "query_id", "left")
                        .select("query_id", "block", "n", F.coalesce("seed", F.lit(False)).alias("seed"), reaches(F.col("limit")).alias("reaches")))
    roles = cut_lineage(_rare_first(index, terms, thresholds, spare))
    open_blocks = rated.where(F.col("reaches") & ~F.col("seed"))
    # per (question, block) the rare tokens' postings and the bounds of the others: at most block_docs x tokens
    halves = _opened(index, roles, open_blocks).groupBy("query_id", "block").agg(
        F.flatten(F.collect_list(F.when(F.col("rare"), F.col("postings")))).alias("postings"),
        F.round(F.coalesce(F.sum(F.when(~F.col("rare"), F.col("bound"))), F.lit(0.0)), 9).alias("still"))
    partial = (halves.select("query_id", "block", "still", F.inline("postings")).groupBy("query_id", "block", "doc_id")
               .agg(F.sum("weight").alias("weight"), F.max("still").alias("still")))
    alive = cut_lineage(partial.join(thresholds, "query_id", "left").where(reaches(F.round(F.col("weight") + F.col("still"), 9)))
                        .select("query_id", "block", "doc_id", "weight"))
    common = _opened(index, roles.where(~F.col("rare")), alive).select("query_id", "block", F.inline("postings"))
    common = common.join(alive.select("query_id", "block", "doc_id"), ["query_id", "block", "doc_id"], "left_semi")
    rest = _sums(alive.unionByName(common)).select("query_id", "doc_id", score)
    hits = top_k_within(best.drop("rank").unionByName(rest), ["query_id"], order, k)

    seen = alive.select("query_id", "block").distinct().withColumn("alive", F.lit(True))
    read = F.col("seed") | (F.col("reaches") & (F.col("rare") | F.coalesce("alive", F.lit(False))))
    postings = (index.select("block", "tok", "n").join(bounded(roles), "tok").join(rated.drop("n"), ["query_id", "block"])
                .join(seen, ["query_id", "block"], "left").groupBy("query_id")
                .agg(F.sum("n").alias("postings"), F.sum(F.when(read, F.col("n")).otherwise(0)).alias("postings_read")))
    blocks = rated.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("seed") | F.col("reaches")).alias("blocks_read"))
    return PrunedSearch(hits, postings.join(blocks, "query_id"))
