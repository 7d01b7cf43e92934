"""The registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.llm import (bitslice, chat, classlm, decontaminate, interaction, langid, linededup, merkle, mixing, neardup,
                           ranking, rules, warc)
from lakesmith.llm.common import fold_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and read back an archive record per page; digests come from the records read."""
    got = warc.roundtrip(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    bare = lambda c: F.regexp_replace(c, "^urn:x-row:", "").try_cast("long")
    response = F.col("record_type") == "response"
    return got.select(
        bare(F.col("record_id")).alias("page_id"), F.col("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", bare(F.col("refers_to")).alias("refers_to"), "error")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, and the verdict of the decision list learnt from all labelled statistics."""
    stats = rules.stats_frame(read(spark, sf_dir, "documents"), "doc_id", "text")
    learnt = rules.learn_from(stats, read(spark, sf_dir, "labels"))
    s = F.col("__stats")
    failed = rules.base_failed(s)
    return stats.select(
        F.col("__id").alias("doc_id"), s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"),
        s["c"]["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & rules.verdict(learnt)).alias("kept"))


def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; one fold of four is held out of all learning."""
    docs = read(spark, sf_dir, "documents")
    out_fold = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs, usable=~out_fold)
    return langid.predict(docs, model).select("doc_id", out_fold.alias("held_out"), "lang_pred", "score", "rejected")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations and the probe conversation -1, read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = (spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    return chat.digest(chat.expand_prefixes(turns.unionByName(probe)))


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links (five-word shingles, Jaccard 0.8) of all documents."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and unigram log-probabilities of every whole text; one fold of ten held out."""
    out_fold = F.coalesce(fold_of(F.col("doc_id"), 10) == 0, F.lit(False))
    got = classlm.score(read(spark, sf_dir, "documents"), ~out_fold)
    return got.select("doc_id", out_fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; one fold of five is held out of all learning."""
    docs = read(spark, sf_dir, "documents")
    out_fold = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    ranker = ranking.learn_ranker(docs, read(spark, sf_dir, "labels"), usable=~out_fold)
    return ranking.score_documents(docs, ranker).select(
        "doc_id", out_fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier line up to one word."""
    return linededup.drop_repeated_lines(read(spark, sf_dir, "documents"), lines_col="n_lines",
                                         dropped_col="n_dropped").select("doc_id", "text", "n_lines", "n_dropped")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    got = decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "shared", "item_shingles")


def op10_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, its source's target and the position of its first copy."""
    plan = mixing.assign_positions(read(spark, sf_dir, "documents"))
    return plan.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"),
        F.round(F.try_element_at("__positions", F.lit(1)), 6).alias("first_position")).orderBy("first_position", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document; in one half of the ids the text's line ends are
    deleted before the root is computed again."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = merkle.leaf_rows(read(spark, sf_dir, "documents"), fields, "doc_id", "source",
                              altered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=fold_of(F.col("doc_id"), 2) == 0)
    return merkle.prove(merkle.manifest(leaves)).withColumnRenamed("id", "doc_id")


def op12_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors by integer inner product, of every vector whose id 100 divides."""
    rows = bitslice.quantise(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=1024)
    return bitslice.top_k(rows, F.col("id") % 100 == 0, k=10)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every step of all 120 orders of the five filters keeps and removes, per source."""
    return interaction.audit(interaction.masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    ops = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return ops | {"pipeline": corpus_pipeline.run}


def oracle_queries() -> dict[str, str]:
    from lakesmith.llm.oracle import SQL
    return dict(SQL)
