"""Skew-safe numbering equals the window functions it replaces."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakesmith.operators.sequence import (
    cumulative_sum_within, dense_id, group_percentile, neighbour, sequence_within,
)


def skewed(spark, n=6000):
    # one key holds a third of all rows
    return spark.range(n).select(F.col("id").alias("k"),
                                 F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                                 (F.col("id") * 7919 % 1000).cast("double").alias("v"))


def test_dense_id_matches_row_number(spark):
    df = skewed(spark).repartition(7)
    a = dense_id(df, ["v", "k"], "rid").select("k", "rid")
    b = df.select("k", F.row_number().over(Window.orderBy("v", "k")).cast("long").alias("rid"))
    assert a.exceptAll(b).count() == 0 and a.count() == 6000


def test_sequence_within_hot_group(spark):
    df = skewed(spark)
    for parts in (1, 4, 7):
        a = sequence_within(df.repartition(parts), ["g"], ["v", "k"], "s", num_partitions=parts).select("k", "s")
        b = df.select("k", F.row_number().over(Window.partitionBy("g").orderBy("v", "k")).cast("long").alias("s"))
        assert a.exceptAll(b).count() == 0


def test_sequence_start_column(spark):
    df = skewed(spark).withColumn("base", F.col("g") * 1000)
    a = sequence_within(df, ["g"], ["k"], "s", start=F.col("base")).select("k", "s")
    b = df.select("k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1 + F.col("base")).cast("long").alias("s"))
    assert a.exceptAll(b).count() == 0


def test_neighbour_and_cumsum(spark):
    df = skewed(spark)
    lead = neighbour(df, ["g"], ["k"], ["v"], offset=1).select("k", "next_v")
    lag = neighbour(df, ["g"], ["k"], ["v"], offset=-1, prefix="prev_").select("k", "prev_v")
    w = Window.partitionBy("g").orderBy("k")
    assert lead.exceptAll(df.select("k", F.lead("v").over(w).alias("next_v"))).count() == 0
    assert lag.exceptAll(df.select("k", F.lag("v").over(w).alias("prev_v"))).count() == 0
    cs = cumulative_sum_within(df, ["g"], ["k"], "v", "cs").select("k", "cs")
    ref = df.select("k", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"))
    assert cs.exceptAll(ref).count() == 0


def test_group_percentile(spark):
    df = skewed(spark)
    a = {r["g"]: round(r["p"], 9) for r in group_percentile(df, ["g"], "v", 0.95, "p").collect()}
    b = {r["g"]: round(r["p"], 9) for r in df.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert a == b


def test_group_percentile_with_massive_ties(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"),
                                  F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("v"))
    a = {r["g"]: round(r["p"], 9) for r in group_percentile(df, ["g"], "v", 0.5, "p").collect()}
    b = {r["g"]: round(r["p"], 9) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert a == b
