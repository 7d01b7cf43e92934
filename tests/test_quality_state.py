"""Merged batch states give the one-pass quality report."""

from pyspark.sql import functions as F

from lakesmith.operators import medallion as M
from lakesmith.operators import quality_state as QS


def report(df):
    return {r["metric_name"]: r["metric_value"] for r in df.collect()}


def states(rows, parts):
    out = None
    for i in range(parts):
        one = QS.quality_state(rows.where(F.col("id") % parts == i), "name", ("use",), "dose", "low")
        out = one if out is None else out.unionByName(one)
    return out


def test_counts_are_exact_and_estimates_close(spark):
    n = 40_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 50 == 0, F.lit("  ")).otherwise(F.concat(F.lit("name"), (F.col("id") % 23_000).cast("string"))).alias("name"),
                                 F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("use")).alias("use"), F.lit("5g").alias("dose"),
                                 F.when(F.col("id") % 3 == 0, 5.0).alias("low"))
    want = report(M.quality_report(rows, "name", ("use",), "dose", "low", with_timestamps=False))
    for parts in (1, 6):
        got = report(QS.report(QS.merge_states(states(rows, parts))))
        assert set(got) == set(want)
        for metric, value in want.items():
            if metric in QS.ESTIMATED:
                assert abs(got[metric] - value) <= 4 * QS.standard_error() * 23_000
            else:
                assert got[metric] == value
    few = rows.where("id < 500")
    assert report(QS.report(QS.merge_states(states(few, 4)))) == report(M.quality_report(few, "name", ("use",), "dose", "low", with_timestamps=False))


def test_empty_batches(spark):
    rows = spark.createDataFrame([], "id long, name string, use string, dose string, low double")
    got = report(QS.report(QS.merge_states(states(rows, 2))))
    assert set(got.values()) == {0}
    assert set(report(QS.report(QS.merge_states(states(rows, 1).limit(0)))).values()) == {0}
