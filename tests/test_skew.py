"""One key holding a third of all rows: grouped operators combine map-side
(partial aggregate before the shuffle) and still give the exact answer."""

from pyspark.sql import functions as F

from lakesmith.operators import conversations as CV
from lakesmith.operators import medallion as M


def hot(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("name"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("a"),
        F.concat(F.lit("q"), (F.col("id") % 7).cast("string")).alias("text"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_by_name_partial_and_exact(spark):
    df = hot(spark).repartition(6)
    out = M.merge_by_name(df, "name", "ord", ["a"])
    assert "partial_min_by" in plan(out)
    rows = {r["name"]: (r["ord"], r["a"]) for r in out.collect()}
    data = sorted((r["ord"], r["name"], r["a"]) for r in df.collect())
    for name in {d[1] for d in data}:
        mine = [d for d in data if d[1] == name]
        first_a = next((d[2] for d in mine if d[2] is not None), None)
        assert rows[name] == (mine[0][0], first_a)


def test_keep_first_partial_and_exact(spark):
    df = hot(spark).repartition(6)
    out = M.keep_first(df, ["name"], ["ord"])
    assert "partial_min_by" in plan(out)
    assert {r["name"]: r["ord"] for r in out.collect()}["hot"] == 0


def test_cache_hits_hot_question(spark):
    df = hot(spark).select(F.lit(1).alias("conv_id"), F.col("ord").alias("turn"), "text")
    out = CV.cache_hits(df, ["conv_id", "turn"])
    assert "partial_min" in plan(out)
    firsts = {r["turn"] for r in out.where(~F.col("hit")).collect()}
    assert firsts == set(range(7))  # the first occurrence of each of the 7 texts
