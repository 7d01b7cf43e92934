"""Retrieval operators against brute force and the rerank fixture."""

import re

import numpy as np
from pyspark.sql import functions as F

from lakesmith.operators import chunking as C
from lakesmith.operators import retrieval as R
from lakesmith.plans import retrieval_queries as RQ

from conftest import SF001


def test_rerank_fixture(spark):
    # herbs [h], diseases [d]; three documents in vector order (FIXTURES 2.8)
    hits = spark.createDataFrame([
        (1, 10, 1, "zzz", [], "không xác định"),
        (1, 11, 2, "zzz", ["h"], "dd"),
        (1, 12, 3, "h and d inside", [], "không xác định")],
        "query_id long, doc_id long, rank long, text string, herb_tags array<string>, disease_tag string")
    s = hits.withColumn("entity_score", R.entity_score(F.array(F.lit("h")), F.array(F.lit("d")), F.col("herb_tags"),
                                                       F.col("disease_tag"), F.col("text")))
    s = s.withColumn("source", F.lit("s"))
    out = R.weighted_rerank(s).orderBy("new_rank").collect()
    assert [r["doc_id"] for r in out] == [11, 10, 12]
    assert [r["entity_score"] for r in out] == [5, 0, 3]
    assert [r["final_score"] for r in out] == [0.775, 0.45, 0.33]


def test_blank_herb_scores_zero(spark):
    df = spark.createDataFrame([("text",)], "t string")
    assert df.select(R.entity_score(F.array(F.lit("")), F.array(), F.array(), F.lit(""), F.col("t"))).first()[0] == 0


def test_recursive_chunks_bounded_and_cover(spark):
    docs = RQ.docs(spark, SF001).orderBy("doc_id").limit(50)
    chunks = C.chunk_recursive(docs).collect()
    assert all(len(r["chunk_text"]) <= C.CHUNK_SIZE for r in chunks)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in chunks:
        assert r["chunk_text"] in texts[r["doc_id"]]


def test_split_recursive_small():
    assert C.split_recursive("a b c", 1200, 350) == ["a b c"]
    parts = C.split_recursive("word " * 600, 100, 20)
    assert all(len(p) <= 100 for p in parts) and len(parts) > 20


def test_tag_filter_brute_force(spark):
    tags = [(1, "gingerroot"), (1, "fever"), (2, "ginger"), (3, "mint"), (4, "")]
    asked = [(7, "Ginger"), (7, "mint!"), (8, "rootx"), (9, ""), (9, None)]
    got = R.tag_filter(spark.createDataFrame(tags, "doc_id long, tag string"),
                       spark.createDataFrame(asked, "query_id long, entity string")).collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 2), (7, 3)]


def test_dense_topk_brute_force(spark):
    emb = RQ.table(spark, SF001, "embeddings")
    got = RQ.q_dense_topk(spark, SF001).collect()
    e = {r["vec_id"]: np.asarray(r["embedding"], dtype=float) for r in emb.collect()}
    probes = {r["query_id"]: np.asarray(r["qvec"], dtype=float) for r in RQ.probes(spark, SF001).collect()}
    for label, q in probes.items():
        sims = sorted(((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), k) for k, v in e.items()))[:10]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["label"] == label)
        assert [k for _, k in sims] == [k for _, k in mine]


def test_bm25_from_stored_index_equals_search(spark):
    """A question of 1,500 words keeps every term; the stored index is read without an exchange below the limit."""
    docs = RQ.docs(spark, SF001)
    long_text = " ".join(f"w{i}" for i in range(1490)) + " " + " ".join(r["text"] for r in docs.limit(3).collect())
    q = RQ.questions(spark, SF001).unionByName(spark.createDataFrame([(10**6, long_text)], "query_id long, text string"))
    terms = R.query_terms(q, "query_id")
    stored = R.bm25_topk(RQ.stored_index(spark, SF001), terms)
    fresh = R.bm25_search(docs, terms)
    assert stored.exceptAll(fresh).count() == 0 and fresh.exceptAll(stored).count() == 0
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "regexp_extract_all" not in plan.split("HashedRelationBroadcastMode")[0]
    # the exchanges: the questions' distinct terms, and the k best rows of every question
    assert "hashpartitioning(doc_id" not in plan and not re.search(r"hashpartitioning\(query_id#\d+L, doc_id", plan)


def test_hashed_vectors_unit_length(spark):
    v = R.hashed_vectors(RQ.docs(spark, SF001), "doc_id", "text", num_features=1 << 12)
    bad = v.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).where(F.abs(F.col("n") - 1) > 1e-9)
    assert bad.count() == 0


def test_query_blocks_give_same_results(spark):
    """Blocks are counted in rows: several vectors of one question may fall into different blocks."""
    emb = RQ.table(spark, SF001, "embeddings")
    many = emb.select(F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("qvec")).limit(40)
    for metric in ("cosine", "euclidean"):
        a = R.dense_topk(emb, many, "vec_id", "embedding", "query_id", "qvec", metric=metric)
        b = R.dense_topk(emb, many, "vec_id", "embedding", "query_id", "qvec", metric=metric, max_queries=3)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dense_topk_odd_vectors(spark):
    """NULL, all-zero and NaN vectors are neither found nor ask; k rows a question and partition leave the scorer."""
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0])],
                                 "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "q long, w array<double>")
    got = R.dense_topk(docs, asked, "id", "v", "q", "w").collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(1, 1, 1), (1, 2, 5)]
    big = spark.range(3000).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v")).repartition(3)
    parts = R._dense_partials(big, np.array([1, 2]), np.array([[1.0, 0.0], [0.0, 1.0]]), "id", "v", 5, "euclidean", 6)
    assert parts.count() <= 5 * 2 * max(parts.rdd.getNumPartitions(), 1)


def test_empty_question_table(spark):
    emb = RQ.table(spark, SF001, "embeddings")
    none = RQ.probes(spark, SF001).where("false")
    assert R.dense_topk(emb, none, "vec_id", "embedding", "query_id", "qvec").count() == 0


def test_substring_filter_on_pieces(spark):
    """Tags that contain the normalised entity: short, long, repeated, blank and null ones; pieces grow linearly."""
    tags = ["abc", "ab", "a", "b", "xabcx", "cough and cold", "COLD", "aaaa", "", None, "a b", "é", "x" * 500]
    asked = ["a", "ab", "abc", "cold", "Cold ", "aaa", "and c", "", "  ", None, "zzz", "abcd", "é", "x" * 40, "b"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(tags + tags[:3])], "doc_id long, tag string")
    e = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "query_id long, entity string")
    got = sorted((r["entity"], r["tag"]) for r in R.matching_tags(t, e).collect())
    norm = lambda x: " ".join(x.lower().split())
    want = sorted({(x, y) for x in asked if x and norm(x) for y in tags if y and norm(x) in y})
    assert got == want
    lengths = {n: spark.createDataFrame([("".join(chr(0x4E00 + i) for i in range(n)),)], "tag string").select(
        *[F.size(R._qgrams("tag", k)) for k in (1, 2, 3)]).first() for n in (2, 50, 100)}
    assert [sum(v) for v in lengths.values()] == [3, 147, 297]
