"""Block-bounded BM25, the dense index of cells, and indexes that follow their table."""

import shutil

import numpy as np
from pyspark.sql import functions as F

from lakesmith.operators import dense_index as DI
from lakesmith.operators import pruning as PR
from lakesmith.operators import retrieval as R
from lakesmith.plans import retrieval_queries as RQ
from lakesmith.session import scratch_path

from conftest import SF001


def corpus(spark, n=400):
    """Common words everywhere, rare ones in few documents, ties, an empty and a null text."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = ["common"] * int(rng.integers(1, 6)) + [f"w{int(x)}" for x in rng.zipf(1.4, size=int(rng.integers(3, 60))) % 200]
        if i % 40 == 0:
            words += ["rare", "topic", f"only{i}"] * 3
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows + [(n, ""), (n + 1, None), (n + 2, rows[0][1]), (n + 3, rows[0][1])], "doc_id long, text string")


def index_of(spark, docs, **options):
    name = f"pruned_{abs(hash(str(options)))}"
    return PR.build_block_index(docs, name, scratch_path(spark, name), **options)


def test_pruned_topk_equals_the_full_sum(spark):
    docs = corpus(spark)
    asked = spark.createDataFrame([(1, "rare topic common"), (2, "common"), (3, "only40 only80"), (4, "unknown"), (5, "w1 w2 w3 common rare"), (6, "")],
                                  "item_id long, text string")
    terms = R.query_terms(asked)
    full = R.bm25_search(docs, terms)
    want = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in full.collect())
    for options in ({"block_docs": 8}, {"block_docs": 1}, {"block_docs": 1000}):
        found = PR.bm25_topk_pruned(index_of(spark, docs, **options), terms)
        assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.hits.collect()) == want
    work = {r["query_id"]: r for r in PR.bm25_topk_pruned(index_of(spark, docs, block_docs=8), terms).work.collect()}
    assert set(work) == {1, 2, 3, 5}
    assert work[1]["blocks_read"] < work[1]["blocks"] / 2 and work[1]["postings_read"] < work[1]["postings"] / 2
    assert work[3]["blocks_read"] == work[3]["blocks"]  # fewer than k documents hold its words: no threshold


def test_filter_scores_cut_in_the_tasks(spark):
    """The cut to the best ``k`` keeps both lists of every question; all rows are the plain sums."""
    docs = corpus(spark, 300).unionByName(spark.createDataFrame([(None, "rare common"), (5, "rare topic")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "rare topic common"), (2, "common"), (3, "only40 only80"), (4, "unknown"), (None, "w1 rare"), (6, "")],
                                  "item_id long, text string")
    terms, index = R.query_terms(asked), R.postings(docs)
    wanted = spark.createDataFrame([(1, "w2"), (1, "w3"), (2, "rare"), (4, "common"), (None, "w5")], "query_id long, tag string")
    plain = {(q, i): s for q, i, s in R.bm25_scores(index, terms).collect()}
    tags = {}
    for i, t in index.select("doc_id", "tok").collect():
        tags.setdefault(i, set()).add(t)
    pairs = [tuple(r) for r in wanted.collect()]
    want = {(q, i): (s, any(a == q and t in tags[i] for a, t in pairs)) for (q, i), s in plain.items()}
    for most in (4096, 2):
        got = {(r[0], r[1]): (r[2], r[3]) for r in R.bm25_filter_scores(index, terms, wanted, max_queries=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[x][0] - s) < 2e-6 and got[x][1] == a for x, (s, a) in want.items())
    best = lambda rows, k: {(q, g, i) for q in {x[0] for x in rows} for g in (False, True)
                            for i in [i for _, n, i in sorted((-s, (i is not None, i or 0), i) for (p, i), (s, a) in rows.items()
                                                              if p == q and (a or not g))][:k]}
    for k in (1, 3, 1000):
        cut = {(r[0], r[1]): (r[2], r[3]) for r in R.bm25_filter_scores(index.coalesce(2), terms, wanted, k=k).collect()}
        assert best(cut, k) == best(got, k) and all(got[x] == v for x, v in cut.items())
    assert R.bm25_filter_scores(index, terms, wanted, k=1).count() < len(want) / 2
    assert R.bm25_filter_scores(index, terms.limit(0), wanted.limit(0), k=3).collect() == []


def test_stored_tables_have_buckets_for_their_text(spark, tmp_path, monkeypatch):
    (tmp_path / "data").mkdir()
    corpus(spark).selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars").write.parquet(str(tmp_path / "data" / "documents.parquet"))
    d, least = str(tmp_path / "data"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert RQ.index_buckets(spark, d) == least
    monkeypatch.setattr(RQ, "_STORED", {})
    monkeypatch.setattr(RQ, "BUCKET_BYTES", 1000)
    assert RQ.index_buckets(spark, d) > least
    assert RQ.stored_index(spark, d, "chunks").count() == R.postings(RQ.stored_chunks(spark, d), "chunk_uid").count() > 0


def test_pruned_topk_of_empty_tables(spark):
    terms = R.query_terms(spark.createDataFrame([(1, "a")], "item_id long, text string"))
    index = index_of(spark, corpus(spark).limit(0), block_docs=16)
    assert PR.bm25_topk_pruned(index, terms).hits.collect() == []
    assert PR.bm25_topk_pruned(index_of(spark, corpus(spark, 20)), terms.limit(0)).hits.collect() == []


def clustered(spark, n=3000, dims=16, groups=40, hot=0.4):
    """Vectors around centres; one centre holds a large share; some have no direction."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(groups, dims))
    of = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    points = centres[of] + rng.normal(scale=0.25, size=(n, dims))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, rows[7][1])],
                                 "vec_id long, embedding array<double>")


def test_cells_find_nine_of_ten(spark):
    vectors = clustered(spark)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact = R.dense_topk(vectors, asked, "vec_id", "embedding", "query_id", "qvec").withColumnRenamed("vec_id", "id")
    index = DI.build_dense_index(vectors, scratch_path(spark, "cells"), "vec_id", "embedding")
    assert index.vectors().count() == 3001 and index.sizes.count() <= 54
    found = DI.dense_topk_cells(index, asked, "query_id", "qvec")
    r = DI.recall(found, exact).first()
    assert (r["questions"], r["wanted"]) == (30, 300) and r["found"] / r["wanted"] == r["recall"] >= 0.9
    # scores are exact; small pieces and blocks of questions change nothing; all cells give the exact result
    assert found.join(exact, ["query_id", "id"]).where(found["score"] != exact["score"]).count() == 0
    split = DI.dense_topk_cells(index, asked, "query_id", "qvec", piece_rows=50, question_rows=4)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, found.collect()))
    every = DI.dense_topk_cells(index, asked, "query_id", "qvec", probes=10_000)
    assert DI.recall(every, exact).first()["recall"] == 1.0


def test_cells_of_odd_tables(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")
    ask = lambda df: df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    for i, (table, questions, want) in enumerate(((none, one, []), (one, none, []), (one, one.where("vec_id = 6"), [(6, 5), (6, 6), (6, 7)]))):
        index = DI.build_dense_index(table, scratch_path(spark, f"odd{i}"), "vec_id", "embedding", cells=4)
        assert sorted((r["query_id"], r["id"]) for r in DI.dense_topk_cells(index, ask(questions), "query_id", "qvec").collect()) == want


def test_stored_index_follows_its_table(spark, tmp_path):
    """A document added within the session is found."""
    d = tmp_path / "data"
    d.mkdir()
    for name in ("documents", "benchmark"):
        shutil.copy(f"{SF001}/{name}.parquet", d / f"{name}.parquet")
    before = RQ.q_bm25_topk(spark, str(d))
    assert before.where("doc_id = 999999").count() == 0
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").where("text is not null").orderBy("item_id").first()
    more = spark.createDataFrame([(999999, item["text"], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).coalesce(1).write.parquet(str(tmp_path / "new"))
    part = next((tmp_path / "new").glob("part-*.parquet"))
    shutil.copy(part, d / "documents.parquet")
    spark.catalog.refreshByPath(str(d))
    hits = RQ.q_bm25_topk(spark, str(d)).where("doc_id = 999999").collect()
    assert item["item_id"] in {r["item_id"] for r in hits}
    pruned = RQ.q_bm25_pruned_topk(spark, str(d)).where("doc_id = 999999").collect()
    assert sorted(map(tuple, pruned)) == sorted(map(tuple, hits))


def test_fit_sample_is_the_head_of_the_hash_order(spark):
    """The bounded read takes the rows of a plain limit; few ids of many rows fall back to all rows."""
    for rows, count in (([(i,) for i in range(3000)], 40), ([(i % 3,) for i in range(3000)], 40), ([(1,)], 5), ([], 5)):
        df = spark.createDataFrame(rows, "id long").repartition(6)
        want = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(count).collect()]
        assert sorted(r["id"] for r in DI.first_hashed(df, F.xxhash64("id"), "id", count).collect()) == sorted(want)


def test_index_build_moves_texts_not_tokens(spark):
    """One exchange, of rows of the table; a repeated id counts as one document."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, None), (None, "b b"), (3, "A")], "doc_id long, text string")
    index = R._text_index(docs, "doc_id", "text", 3)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("Generate") < plan.index("RepartitionByExpression")
    key = lambda r: str(tuple(r))
    assert sorted(index.collect(), key=key) == sorted(R.postings(docs).select(*index.columns).collect(), key=key)
