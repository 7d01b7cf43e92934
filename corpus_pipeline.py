"""The corpus pipeline: raw documents to a training sequence, in five stages.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame`` that works on all that its
predecessor kept; all but the last return the columns of ``documents``.  Rows are told apart by id
and text, so null ids and repeated rows need no special care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.llm import decontaminate, linededup, mixing, neardup, rules
from lakesmith.llm.common import BLANKS, materialise
from lakesmith.llm.queries import read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the decision list learnt from ``labels`` stay; null and empty texts
    fail the base (fewer than ten words) and go."""
    learnt = rules.learn_from(rules.stats_frame(docs, "doc_id", "text"), read(spark, sf_dir, "labels"))
    return rules.keep_good(docs, learnt)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; documents of which nothing is left go with them, texts that had no
    line to begin with stay."""
    x = linededup.drop_repeated_lines(docs, lines_col="__lines", dropped_col="__dropped")
    return x.where((F.col("__dropped") == 0) | (F.col("__lines") > F.col("__dropped"))).drop("__lines", "__dropped")


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate group the row of smallest id (a null id first) stays; texts without words all stay."""
    near = neardup.near_duplicates(docs, keep_hash=True)
    chosen = (near.where(F.col("__root").isNotNull()).groupBy("__root")
              .agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("__th").alias("h"))).alias("__k")).select("__k").distinct())
    keyed = docs.withColumn("__k", F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""
    kept = keyed.where(~blank).join(chosen, "__k").dropDuplicates(["__k"])
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more go (one of a word or two is part of clean
    texts); null and empty texts hold none and stay."""
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    leaks = decontaminate.find_items(keyed, read(spark, sf_dir, "benchmark"), id_col="__k", short_items=False)
    return keyed.join(leaks.select(F.col("id").alias("__k")).distinct(), "__k", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row per taken copy, range-sorted by position.  Texts without words follow
    their source's whole repeats."""
    return mixing.curriculum(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_dedup", jaccard_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
]

#: The learnt rules have no SQL form; tests/llm holds plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
