"""Retrieval operators (R1-R10, J5, J6, J11): batch jobs over many
documents and many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lakesmith.functions import text as T
from lakesmith.functions.vectors import cosine
from lakesmith.operators.parallel import spread
from lakesmith.operators.sequence import top_k_within

# Catalogue titles of the known source files (file name -> title).
SOURCE_TITLES = {
    "cay_canh_cay_thuoc.md": "Cây cảnh - Cây thuốc trong nhà trường\n        Tác giả: Nguyễn Hữu Đảng\n        Nhà xuất bản: Giáo dục\n        Tái bản lần thứ nhất",
    "cay_qua_cay_thuoc.md": "CÂY QUẢ CÂY THUỐC\n        BỘ Y TẾ VỤ Y HỌC CỔ TRUYỀN\n        (Tái bản lần thứ 5 có sửa chữa)\n        NHÀ XUẤT BẢN Y HỌC\n        HÀ NỘI - 2005",
    "cay_rau_lam_thuoc.md": "Cây rau làm thuốc\n        Tác giả: Pts. Võ Văn Chi\n        Nhà xuất bản Tổng hợp Đồng Tháp",
    "cay_thuoc_thong_dung.md": "Cây thuốc trị bệnh thông dụng\n        Tủ sách Y dược học\n        PTS. VÕ VĂN CHI\n        NHÀ XUẤT BẢN THANH HÓA",
    "duoclieutrungcap.md": "DƯỢC LIỆU TRUNG CẤP\n        BỘ Y TẾ VỤ Y HỌC CỔ TRUYỀN\n        (SÁCH DÙNG ĐÀO TẠO DƯỢC SỸ TRUNG HỌC)\n        NHÀ XUẤT BẢN Y HỌC",
    "so_tay_thuoc_nam.md": "SỔ TAY THUỐC NAM CHỮA BỆNH TUYẾN CƠ SỞ\n      TỔNG CỤC HẬU CẦN CỤC QUÂN Y\n        (Tái bản lần thứ nhất có chỉnh lý và bổ sung)\n        NHÀ XUẤT BẢN QUÂN ĐỘI NHÂN DÂN\n        Hà Nội - 2005",
}


def source_title_dim(spark: SparkSession) -> DataFrame:
    """J5 dimension: a fixed six-row table, safe to broadcast."""
    return spark.createDataFrame(list(SOURCE_TITLES.items()), "file_name string, title string")


# Retrieval depth, BM25 parameters of the sparse model, fusion
# constant, rerank weights, fallback answer and default tag label.
SEARCH_K = 10
BM25_K1, BM25_B, BM25_AVG_LEN = 1.2, 0.75, 256.0
RRF_C = 2
ENTITY_WEIGHT, VECTOR_WEIGHT = 0.55, 0.45
NO_ANSWER = "Xin lỗi, tôi chưa có thông tin về vấn đề này trong cơ sở dữ liệu hiện tại."
UNKNOWN_TAG = "không xác định"
DOC_TEMPLATE = ("Nội dung: ", "\nNguồn trích dẫn: ", "\n---")
DOC_SEPARATOR = "\n\n"

TOKEN = r"[\p{L}\p{N}]+"
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` after proving it small in rows and in bytes (JSON length of its rows).

    The proof reads at most ``max_rows + 1`` rows in one aggregate; over either bound the frame is
    returned unhinted and the planner shuffles instead (AQE may still broadcast from measured sizes)."""
    if getattr(df, "_bounded_rows", None) is not None:
        return df
    n, size = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    out = F.broadcast(df) if n <= max_rows and size <= max_bytes else df
    out._bounded_rows = n
    return out


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A small intermediate read by several branches: cut its lineage once
    (``checkpoint``) and size-check it once; the returned frame carries its
    broadcast decision, so later :func:`bounded` calls cost nothing."""
    from lakesmith.session import cut_lineage
    return bounded(cut_lineage(df), max_rows)


def tokens(c: str | Column) -> Column:
    """Lower-cased letter/digit runs (the shared tokenizer)."""
    return F.regexp_extract_all(F.lower(T.col_(c)), F.lit(TOKEN), 0)


# ----------------------------------------------------------------------------- postings / BM25

def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per token occurrence ``(doc_id, tok, doc_len)``; the text is
    tokenised once (the length travels inside the generated struct)."""
    return _occurrences(spread(docs, id_col), id_col, text_col)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    return toks.select("doc_id", F.inline(F.transform(
        "toks", lambda t: F.struct(t.alias("tok"), F.size("toks").cast("long").alias("doc_len")))))


def _index(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts per (document, token), partitioned by document alone, so that scoring needs no other exchange."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _counts(rows.repartition(n, "doc_id"))


def _text_index(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """:func:`_index` of whole texts: the texts move, once, and their tokens are counted where they land; a
    token row is several times as long as the token in its text."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition(n, "doc_id")
    return _counts(_occurrences(placed, "doc_id", "text"))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """R3 index: ``(doc_id, tok, tf, doc_len)``; tokens are generated map-side."""
    return _counts(token_rows(docs, id_col, text_col))


def build_index(docs: DataFrame, name: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                buckets: int | None = None) -> DataFrame:
    """Write the postings as table ``name`` at ``path``, bucketed by document and sorted by
    (document, token); returns the stored table.  Scores over it aggregate inside a bucket."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (_text_index(docs, id_col, text_col, n).write.bucketBy(n, "doc_id").sortBy("doc_id", "tok")
     .option("path", path).mode("overwrite").saveAsTable(name))
    return spark.table(name)


def query_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The part of the R3 index a query batch can touch: token occurrences
    outside the batch's vocabulary are dropped map-side (broadcast semi-join
    against the size-checked vocabulary) before anything is shuffled."""
    vocab = bounded(terms.select("tok").distinct())
    return _index(token_rows(docs, id_col, text_col).join(vocab, "tok", "left_semi"))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct tokens per query (each weighs 1 on the query side)."""
    return queries.select(F.col(id_col).alias("query_id"),
                          F.explode(F.array_distinct(tokens(text_col))).alias("tok"))


def _bm25_weight(k1: float = BM25_K1, b: float = BM25_B, avg_len: float = BM25_AVG_LEN) -> Column:
    return (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.lit(avg_len)))


def bm25_scores(index: DataFrame, terms: DataFrame, digits: int = 6) -> DataFrame:
    """BM25 sum per (query, document) over shared terms.  The query terms are broadcast after a size
    check, so the index is streamed; an index partitioned by document (stored buckets, or
    :func:`query_postings`) is aggregated where it lies.  A hot term only lengthens the stream."""
    j = index.join(bounded(terms.select("query_id", "tok").distinct()), "tok")
    return j.groupBy("query_id", "doc_id").agg(F.round(F.sum(_bm25_weight()), digits).alias("score"))


def bm25_filter_scores(index: DataFrame, terms: DataFrame, wanted: DataFrame, digits: int = 6, k: int | None = None,
                       max_queries: int = 4096) -> DataFrame:
    """BM25 scores and the metadata filter in one pass, ``(query_id, doc_id, score, allowed)``: ``allowed`` is true
    where the document holds one of the tags that the question wants, ``(query_id, tag)``.

    A posting that many questions ask for stays one row: the tokens met are gathered per document where the index
    lies, and the sums over questions are formed in arrays.  With ``k`` only rows that can be among the best ``k`` of a
    question, by (score desc, doc_id) over all or over its allowed documents, leave a task.  Questions travel in
    blocks of at most ``max_queries``."""
    keys = terms.select("query_id", "tok").distinct().withColumn("term", F.lit(True)).join(
        wanted.select("query_id", F.col("tag").alias("tok")).distinct().withColumn("wanted", F.lit(True)),
        ["query_id", "tok"], "full_outer")
    blocks = query_blocks(keys.select("query_id").distinct(), "query_id", max_queries)
    parts = []
    for block in blocks:
        of = block.withColumnRenamed("query_id", "__q")
        mine = keys if len(blocks) == 1 else keys.join(of, F.col("query_id").eqNullSafe(F.col("__q")), "left_semi")
        parts.append(_filter_sums(index, mine, digits, k))
    return _union(parts)


def _filter_sums(index: DataFrame, keys: DataFrame, digits: int, k: int | None) -> DataFrame:
    """:func:`bm25_filter_scores` of one block of ``(query_id, tok, term, wanted)``."""
    spark = index.sparkSession
    got = keys.toArrow().combine_chunks()
    ids, toks = (got.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "tok"))
    q, no = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, toks))
    n_tok, n_q = len(toks.dictionary), len(ids.dictionary)

    def by_token(flag: str):
        """The questions of every token: where its run starts, and the runs one behind the other."""
        on = np.flatnonzero(got.column(flag).fill_null(False).to_numpy())
        on = on[np.argsort(no[on], kind="stable")]
        return np.searchsorted(no[on], np.arange(n_tok + 1)), q[on]
    shared = spark.sparkContext.broadcast((ids.dictionary, by_token("term"), by_token("wanted")))
    vocab = spark.createDataFrame(pa.table({"tok": toks.dictionary, "no": pa.array(np.arange(n_tok), pa.int32())}), "tok string, no int")
    held = index.join(bounded(vocab), "tok").groupBy("doc_id").agg(F.collect_list("no").alias("no"), F.collect_list(_bm25_weight()).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, (start, asked), (tag_start, tag_asked) = shared.value
        floor = np.zeros((2, n_q))  # what the best k reach so far, over all and over the allowed documents
        pool: list[tuple] = []      # (questions, scores, allowed, ids) of the rows that are still in

        def expand(rows, no, first, runs):
            """``(entry, cell)``: a cell of the slice, row times question, for every question of every entry."""
            n = first[no + 1] - first[no]
            entry = np.repeat(np.arange(len(no)), n)
            at = np.arange(len(entry)) + np.repeat(first[no] - (np.cumsum(n) - n), n)
            return entry, rows[entry] * n_q + runs[at]

        def scores(names, lens, no, w):
            n = len(lens)
            rows = np.repeat(np.arange(n), lens)
            entry, cell = expand(rows, no, start, asked)
            total = np.round(np.bincount(cell, weights=w[entry], minlength=n * n_q), digits).reshape(n, n_q)
            met = np.zeros(n * n_q, dtype=bool)
            met[cell] = True
            met = met.reshape(n, n_q)
            allowed = np.zeros(n * n_q, dtype=bool)
            allowed[expand(rows, no, tag_start, tag_asked)[1]] = True
            allowed = allowed.reshape(n, n_q)
            if k is not None:
                inside = np.where(allowed, total, 0)
                if n >= k:
                    for g, x in enumerate((total, inside)):
                        np.maximum(floor[g], np.partition(x, n - k, axis=0)[n - k], out=floor[g])
                met &= (total >= floor[0]) | (allowed & (total >= floor[1]))
            row, question = np.nonzero(met)
            pool.append((question, total[row, question], allowed[row, question], names.take(pa.array(row))))

        def best():
            """The pool cut to the best ``k`` of every question, twice."""
            question, score, allowed = (np.concatenate([p[i] for p in pool]) for i in range(3))
            names = pa.concat_arrays([p[3] for p in pool])
            if k is not None:
                place = np.empty(len(names), dtype=np.int64)
                place[pc.sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
                order = np.lexsort((place, -score, question))
                keep = np.zeros(len(names), dtype=bool)
                for g, some in enumerate((order, order[allowed[order]])):
                    of = question[some]
                    rank = np.arange(len(some)) - np.searchsorted(of, of)
                    keep[some[rank < k]] = True
                    last = some[rank == k - 1]
                    np.maximum.at(floor[g], question[last], score[last])
                question, score, allowed, names = question[keep], score[keep], allowed[keep], names.filter(pa.array(keep))
            pool[:] = [(question, score, allowed, names)]

        def rows():
            for question, score, allowed, names in pool:
                for a in range(0, len(names), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([questions.take(pa.array(question[part])), names[part], pa.array(score[part], pa.float64()),
                                                      pa.array(allowed[part], pa.bool_())], names=["query_id", "doc_id", "score", "allowed"])

        limit = 1 << 20  # cells of a slice, and sums over them; one document at least
        for b in batches:
            names, lists, weights = b.column(0), b.column(1), b.column(2)
            lens = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lens)
            no, w = lists.flatten().to_numpy(), weights.flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(start[no + 1] - start[no] + tag_start[no + 1] - tag_start[no])])
            work = sums[ends] + n_q * np.arange(1, len(lens) + 1)
            a = 0
            while a < len(lens):
                done = work[a - 1] if a else 0
                z = max(a + 1, int(np.searchsorted(work, done + limit, side="right")))
                at = slice(ends[a] - lens[a], ends[z - 1])
                scores(names[a:z], lens[a:z], no[at], w[at])
                a = z
                if k is None:
                    yield from rows()
                    pool.clear()
                elif sum(len(p[0]) for p in pool) > limit:
                    best()
        if pool:
            best()
            yield from rows()

    kinds = StructType([StructField("query_id", keys.schema["query_id"].dataType), StructField("doc_id", index.schema["doc_id"].dataType),
                          StructField("score", DoubleType()), StructField("allowed", BooleanType())])
    return held.mapInArrow(run, kinds)


def bm25_topk(index: DataFrame, terms: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """Top ``k`` documents per query by (score desc, doc_id); only a partition's best ``k`` move."""
    return top_k_within(bm25_scores(index, terms), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def bm25_search(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = SEARCH_K) -> DataFrame:
    """R3 K1 over documents without a stored index: only the questions' vocabulary is indexed."""
    return bm25_topk(query_postings(docs, terms, id_col, text_col), terms, k).withColumnRenamed("doc_id", id_col)


def topk_with_fallback(scores: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """R7 U5 in one ranking pass over ``(query_id, doc_id, score, allowed)``: every row enters the
    unfiltered group and, when ``allowed``, also the ``filtered`` group; top-``k`` per (query, group);
    a query keeps its filtered list when it has one, else its unfiltered list."""
    groups = F.when(F.col("allowed"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    both = scores.select("query_id", "doc_id", "score", F.explode(groups).alias("filtered"))
    top = top_k_within(both, ["query_id", "filtered"], [F.desc("score"), F.asc("doc_id")], k)
    has = F.max(F.col("filtered").cast("int")).over(Window.partitionBy("query_id"))
    return top.withColumn("__has", has).where(F.col("filtered") | (F.col("__has") == 0)).drop("__has")


def hybrid_with_fallback(scores: DataFrame, dense: DataFrame, dense_allowed: DataFrame, id_col: str = "doc_id",
                         c: int | None = None, k: int = SEARCH_K, digits: int = 9) -> DataFrame:
    """The hybrid search of a question with its metadata filter, ``(query_id, id, rrf, rank, filtered)``.

    ``scores`` is ``(query_id, doc_id, score, allowed)`` of BM25, ``dense`` and ``dense_allowed`` are dense top-``k``
    lists ``(query_id, id, rank)`` over all and over the allowed documents.  Both searches are fused by reciprocal
    rank within the filtered and within the unfiltered group; a question keeps the fused filtered list when it
    has one, else the unfiltered one."""
    c = RRF_C if c is None else c
    groups = F.when(F.col("allowed"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    sparse = top_k_within(scores.select("query_id", "doc_id", "score", F.explode(groups).alias("filtered")), ["query_id", "filtered"],
                          [F.desc("score"), F.asc("doc_id")], k).withColumnRenamed("doc_id", id_col)
    lists = [sparse, dense.withColumn("filtered", F.lit(False)).unionByName(dense_allowed.withColumn("filtered", F.lit(True)), allowMissingColumns=True)]
    points = None
    for part in lists:
        one = part.select("query_id", "filtered", id_col, (F.lit(1.0) / (F.lit(c) + F.col("rank") - 1)).alias("points"))
        points = one if points is None else points.unionByName(one)
    fused = points.groupBy("query_id", "filtered", id_col).agg(F.round(F.sum("points"), digits).alias("rrf"))
    top = top_k_within(fused, ["query_id", "filtered"], [F.desc("rrf"), F.asc(id_col)], k)
    has = F.max(F.col("filtered").cast("int")).over(Window.partitionBy("query_id"))
    return top.withColumn("__has", has).where(F.col("filtered") | (F.col("__has") == 0)).drop("__has")


# ----------------------------------------------------------------------------- dense

def dense_topk_of(pairs: DataFrame, corpus: DataFrame, questions: DataFrame, id_col: str, vec_col: str, qvec: str,
                  k: int = SEARCH_K, digits: int = 6, tie: str | None = None) -> DataFrame:
    """R2 within a filter: the top ``k`` by cosine among each question's allowed ``(query_id, id)`` only, equal ones
    by ``tie``, a column of the pairs (by id without one).  Documents and questions without a vector that has a
    direction are left out."""
    j = (pairs.join(corpus.where(_usable(vec_col)).select(id_col, vec_col), id_col)
         .join(bounded(questions.where(_usable(qvec)).select("query_id", qvec)), "query_id"))
    names = [id_col, tie] if tie else [id_col]
    scored = j.select("query_id", *names, (F.round(cosine(F.col(vec_col), F.col(qvec)), digits) + F.lit(0.0)).alias("score"))
    return top_k_within(scored, ["query_id"], [F.desc("score"), F.asc(names[-1])], k)


def _usable(vec: str) -> Column:
    """A vector that has a direction: not NULL, no NULL or NaN entry, not all zero."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vec, lambda x: x != 0)


def _distances(m: np.ndarray, q: np.ndarray, metric: str, digits: int) -> Iterator[np.ndarray]:
    """Sort keys (smaller is better) of all rows of ``m``, one question at a time."""
    if metric == "cosine":
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for v in q:
        yield np.round(-(m @ (v / np.linalg.norm(v))) if metric == "cosine"
                       else np.sqrt(((m - v) ** 2).sum(axis=1)), digits)


def _dense_partials(corpus: DataFrame, ids: np.ndarray, mat: np.ndarray, id_col: str, vec_col: str,
                    k: int, metric: str, digits: int) -> DataFrame:
    """Each partition's best ``k`` rows per question vector, kept while its batches pass and emitted
    once at the end: at most ``k`` x question vectors x partitions rows leave Python."""
    block = corpus.sparkSession.sparkContext.broadcast((ids, mat))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = block.value
        best = [(np.zeros(0), np.zeros(0, dtype="int64"))] * len(q_ids)
        for pdf in batches:
            if len(pdf) == 0 or len(q_ids) == 0:
                continue
            m = np.stack([np.asarray(v, dtype="float64") for v in pdf[vec_col]])
            rows = pdf[id_col].to_numpy(dtype="int64")
            for j, key in enumerate(_distances(m, q, metric, digits)):
                held, held_ids = best[j]
                near = key <= held[-1] if len(held) == k else np.ones(len(key), dtype=bool)
                keys, names = np.concatenate([held, key[near]]), np.concatenate([held_ids, rows[near]])
                order = np.lexsort((names, keys))[:k]
                best[j] = keys[order], names[order]
        for q_id, (keys, names) in zip(q_ids, best):
            yield pd.DataFrame({"query_id": q_id, id_col: names, "score": -keys if metric == "cosine" else keys})

    return spread(corpus, id_col).mapInPandas(score, f"query_id long, {id_col} long, score double")


def dense_topk(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, qid: str, qvec: str,
               k: int = SEARCH_K, metric: str = "cosine", max_queries: int = 4096, digits: int = 6) -> DataFrame:
    """R2: exact top-``k`` by cosine similarity (or ``euclidean`` distance).

    Question vectors travel in blocks of at most ``max_queries`` ROWS; a question may have several
    vectors, a document then counts with its best one.  Vectors that are NULL, hold a NULL or NaN, or
    are all zero have no direction: such documents are not found and such questions find nothing."""
    corpus = corpus.select(id_col, vec_col).where(_usable(vec_col))
    asked = queries.select(qid, qvec).where(_usable(qvec))
    parts = []
    for block in query_blocks(asked, qid, max_queries):
        pdf = block.toPandas()
        ids = pdf[qid].to_numpy(dtype="int64")
        mat = np.stack([np.asarray(v, dtype="float64") for v in pdf[qvec]]) if len(pdf) else np.zeros((0, 0))
        parts.append(_dense_partials(corpus, ids, mat, id_col, vec_col, k, metric, digits))
    best = F.max("score") if metric == "cosine" else F.min("score")
    scored = _union(parts).groupBy("query_id", id_col).agg((best + F.lit(0.0)).alias("score"))
    return top_k_within(scored, ["query_id"], [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc(id_col)], k)


def rrf_fuse(rankings: Sequence[DataFrame], id_col: str, c: int = RRF_C, k: int = SEARCH_K,
             digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of several ``(query_id, id, rank)`` lists
    (1-based ``rank``; the fusion uses the 0-based rank): full outer joins,
    ``sum(1 / (c + rank0))``, then the fused top ``k``."""
    fused = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", id_col, (F.lit(1.0) / (F.lit(c) + F.col("rank") - 1)).alias(f"__s{i}"))
        fused = part if fused is None else fused.join(part, ["query_id", id_col], "full_outer")
    total = sum((F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i in range(len(rankings))), F.lit(0.0))
    fused = fused.select("query_id", id_col, F.round(total, digits).alias("rrf"))
    return top_k_within(fused, ["query_id"], [F.desc("rrf"), F.asc(id_col)], k, "fused_rank")


# ----------------------------------------------------------------------------- metadata filter

def tag_rows(index: DataFrame, lexicon: DataFrame) -> DataFrame:
    """J11 from the stored index: ``(doc_id, tag)`` for every lexicon term a document holds."""
    lex = bounded(lexicon.select(F.col("term").alias("tok")).distinct())
    return index.join(lex, "tok", "left_semi").select("doc_id", F.col("tok").alias("tag"))


QGRAM = 3


def _qgrams(c: str, n: Column | int) -> Column:
    """The distinct ``n``-character pieces of a text (none if it is shorter)."""
    size = F.lit(n) if isinstance(n, int) else n
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: i <= F.length(c) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, size)))


def matching_tags(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity, tag)`` with the normalised entity inside the tag text.

    A tag of ``L`` characters gives at most ``3 L`` pieces of one to three characters.  An entity of up to
    three characters looks itself up among them; a longer one the rarest of its own three-character pieces
    (one that no tag has means no match), and the tags met there are compared in full.  Null, blank and empty
    entities match nothing, null and empty tags are matched by nothing."""
    distinct = tags.select("tag").distinct().where(F.length("tag") > 0)
    pieces = distinct.select("tag", F.explode(F.flatten(F.array(*[_qgrams("tag", n) for n in range(1, QGRAM + 1)]))).alias("key"))
    asked = entities.select("entity", T.normalize_text("entity").alias("sought")).where(F.col("sought") != "").distinct()
    keys = asked.select("entity", "sought", F.explode(_qgrams("sought", F.least(F.length("sought"), F.lit(QGRAM)))).alias("key"))
    known = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rarest = (keys.join(known, "key", "left").groupBy("entity", "sought")
              .agg(F.min_by("key", F.struct(F.coalesce("df", F.lit(0)), "key")).alias("key")))
    return pieces.join(rarest, "key").where(F.contains("tag", F.col("sought"))).select("entity", "tag")


def wanted_tags(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """``(query_id, tag)``: the tags that contain an entity ``(query_id, entity)`` of the question."""
    return entities.join(matching_tags(tags, entities), "entity").select("query_id", "tag").distinct()


def tag_filter(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` of documents with a tag that contains one of the question's entities.

    ``tags`` is ``(doc_id, tag)``, ``entities`` is ``(query_id, entity)``; blank entities match nothing."""
    return tags.join(bounded(wanted_tags(tags, entities)), "tag").select("query_id", "doc_id").distinct()


# ----------------------------------------------------------------------------- entity tags / scores

def lexicon_from(texts: DataFrame, text_col: str, min_len: int, max_len: int | None = None) -> DataFrame:
    """Distinct tokens of a text table within a length band (the tag vocabulary)."""
    t = texts.select(F.explode(tokens(text_col)).alias("term"))
    cond = F.length("term") >= min_len
    if max_len is not None:
        cond = cond & (F.length("term") <= max_len)
    return t.where(cond).distinct()


def ngrams(toks: Column, n: int) -> Column:
    """Space-joined token n-grams of an array column."""
    if n == 1:
        return toks
    idx = F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(0)))
    return F.transform(F.filter(idx, lambda i: i > 0), lambda i: F.array_join(F.slice(toks, i, n), " "))


def entity_tags(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, max_n: int = 1,
                default: str | None = UNKNOWN_TAG) -> DataFrame:
    """Tags of a document = sorted distinct lexicon terms among its
    1..``max_n``-grams (equi-join on the term, lexicon broadcast after a size
    check); no tag -> ``default``.  Output ``tags`` (comma text) and ``tag_list``."""
    toks = spread(docs, id_col).select(F.col(id_col), tokens(text_col).alias("__t"))
    grams = F.array_distinct(F.flatten(F.array(*[ngrams(F.col("__t"), n) for n in range(1, max_n + 1)])))
    exploded = toks.select(id_col, F.explode(grams).alias("term"))
    lex = lexicon if getattr(lexicon, "_bounded_rows", None) is not None else lexicon.select("term").distinct()
    hits = exploded.join(bounded(lex), "term")
    tagged = hits.groupBy(id_col).agg(F.array_sort(F.collect_set("term")).alias("tag_list"))
    out = docs.select(id_col).join(tagged, id_col, "left").withColumn(
        "tag_list", F.coalesce("tag_list", F.array().cast("array<string>")))
    tags = F.array_join("tag_list", ",")
    if default is not None:
        tags = F.when(F.size("tag_list") == 0, F.lit(default)).otherwise(tags)
    return out.withColumn("tags", tags)


def entity_score(herbs: Column, diseases: Column, herb_tags: Column, disease_tag: Column, content_norm: Column) -> Column:
    """R5 per (query, chunk): herb in the tag list +3, else herb inside the
    normalised content +2; disease inside the disease tag text +2, else inside
    the content +1.  Blank entities score 0 (the reference scored a blank herb)."""
    def herb_pts(h: Column) -> Column:
        hn = T.normalize_text(h)
        return (F.when(hn == "", 0).when(F.array_contains(herb_tags, hn), 3)
                .when(F.instr(content_norm, hn) > 0, 2).otherwise(0))

    def disease_pts(d: Column) -> Column:
        dn = T.normalize_text(d)
        tag = T.normalize_text(F.coalesce(disease_tag, F.lit("")))
        return (F.when(dn == "", 0).when(F.instr(tag, dn) > 0, 2)
                .when(F.instr(content_norm, dn) > 0, 1).otherwise(0))

    zero = F.lit(0)
    return (F.aggregate(F.coalesce(herbs, F.array().cast("array<string>")), zero, lambda a, h: a + herb_pts(h))
            + F.aggregate(F.coalesce(diseases, F.array().cast("array<string>")), zero, lambda a, d: a + disease_pts(d)))


def weighted_rerank(hits: DataFrame, entity_col: str = "entity_score", rank_col: str = "rank",
                    tie_cols: Sequence[str] = ("source", "doc_id"), digits: int = 9) -> DataFrame:
    """R6 A11 W4 K3 over each query's retrieved list (bounded by ``k``):
    ``0.55 * entity/max(entity) + 0.45 * (1 - rank0/max(n-1, 1))``, then the
    order (-final, -entity, -vector_rank, ties)."""
    w = Window.partitionBy("query_id")
    mx = F.max(entity_col).over(w)
    n = F.count(F.lit(1)).over(w)
    vr = F.lit(1.0) - (F.col(rank_col) - 1) / F.greatest(n - 1, F.lit(1))
    e = F.col(entity_col) / F.when(mx == 0, F.lit(1)).otherwise(mx)
    scored = hits.withColumn("vector_rank_norm", vr).withColumn(
        "final_score", F.round(ENTITY_WEIGHT * e + VECTOR_WEIGHT * F.col("vector_rank_norm"), digits))
    order = [F.desc("final_score"), F.desc(entity_col), F.desc("vector_rank_norm")] + [F.asc(c) for c in tie_cols]
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


# ----------------------------------------------------------------------------- context / citations

def source_title(source: Column, titles: dict[str, str] = SOURCE_TITLES) -> Column:
    """J5 as an expression: file name -> catalogue title, else the file name."""
    name = T.basename(source)
    m = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    return F.coalesce(m[name], name)


def context_text(ranked: DataFrame, rank_col: str, text_col: str, title_col: str) -> DataFrame:
    """Per query, documents rendered with the document template in rank
    order and joined by a blank line (a query holds at most ``k`` rows)."""
    item = F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"), F.col(title_col).alias("s"))
    rendered = lambda x: F.concat(F.lit(DOC_TEMPLATE[0]), x["t"], F.lit(DOC_TEMPLATE[1]), x["s"], F.lit(DOC_TEMPLATE[2]))
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), rendered), DOC_SEPARATOR).alias("context"),
        F.count(F.lit(1)).alias("n_docs"))


def citations(ranked: DataFrame, rank_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per query the JSON list of ``{content_snippet, metadata:{source}}``."""
    item = F.struct(F.col(rank_col).alias("r"),
                    F.struct(T.citation_snippet(text_col).alias("content_snippet"),
                             F.struct(F.col(source_col).alias("source")).alias("metadata")).alias("c"))
    return ranked.groupBy("query_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])).alias("citations_json"))


def answer_gate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries without any retrieved document get the fixed apology."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"))
    out = queries.join(n, "query_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
    return out.withColumn("gate", F.when(F.col("n_docs") == 0, F.lit(NO_ANSWER)).otherwise(F.lit("answer")))


# ----------------------------------------------------------------------------- index maintenance

def chunk_key(source: Column, start: Column, text: Column) -> Column:
    """Deterministic chunk id."""
    return F.sha2(F.concat_ws("\u001f", source, start.cast("string"), text), 256)


def upsert_new(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows deduplicated on ``key`` (first in ``order``) and
    not already present in ``existing`` (``left_anti``)."""
    from lakesmith.operators.medallion import keep_first
    return keep_first(incoming, [key], list(order)).join(existing.select(key), key, "left_anti")


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, num_features: int = 1 << 18) -> DataFrame:
    """Hashed term-frequency vectors of unit length as sparse rows ``(id, slot, weight)``; the slot
    is the first 32 bits of the token's MD5 modulo ``num_features``.  A text without tokens has no row."""
    slot = (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("long") % F.lit(num_features)).alias("slot")
    counts = token_rows(docs, id_col, text_col).groupBy("doc_id", slot).agg(F.count(F.lit(1)).alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("doc_id")).cast("double"))
    return counts.select(F.col("doc_id").alias(id_col), "slot", (F.col("tf") / norm).alias("weight"))


# ----------------------------------------------------------------------------- query blocks

def query_blocks(queries: DataFrame, qid: str, max_rows: int) -> list[DataFrame]:
    """Split a query table into blocks of at most ``max_rows`` ROWS, each scored separately against
    the corpus (block nested loop).  Rows are numbered in ``qid`` order; one block when all fit."""
    from lakesmith.operators.sequence import dense_id
    n = queries.count()
    if n <= max_rows:
        return [queries]
    ranked = dense_id(queries, [qid], "__qrank")
    block = F.floor((F.col("__qrank") - 1) / F.lit(max_rows))
    return [ranked.where(block == i).drop("__qrank") for i in range(-(-n // max_rows))]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
