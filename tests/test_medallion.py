"""Medallion operators: fixtures and invariance properties."""

from pyspark.sql import functions as F

from lakesmith.operators import medallion as M
from lakesmith.plans import medallion_queries as MQ

from conftest import SF001


def test_merge_by_name_fixture(spark):
    df = spark.createDataFrame([(1, "x", None, "b1"), (2, " X ", "a2", "b2"), (3, None, "a3", None)],
                               "ord long, name string, a string, b string")
    from lakesmith.functions.text import normalize_name
    named = df.withColumn("name", normalize_name("name")).where(F.col("name").isNotNull())
    rows = M.merge_by_name(named, "name", "ord").collect()
    assert [(r["name"], r["a"], r["b"]) for r in rows] == [("x", "a2", "b1")]


def test_silver_gold_invariant_to_partitioning(spark):
    base = sorted(MQ.q_gold_catalog(spark, SF001).collect())
    part = MQ.table(spark, SF001, "part")
    for n in (1, 7):
        shuffled = part.repartition(n).orderBy(F.rand(7))
        bronze = M.to_bronze(shuffled, ["p_partkey"], source_file=F.lit("part.parquet"), with_timestamps=False)
        silver = M.to_silver(bronze, name_candidates=("p_name",), dose_col="p_size", with_timestamps=False)
        assert sorted(M.gold_catalog(silver, MQ.PART_ROLES, with_timestamps=False).collect()) == base


def test_ids_dense_and_unique(spark):
    b = MQ.part_bronze(spark, SF001)
    r = b.agg(F.min(M.BRONZE_ID), F.max(M.BRONZE_ID), F.countDistinct(M.BRONZE_ID), F.count(F.lit(1))).first()
    assert (r[0], r[1], r[2], r[3]) == (1, 2000, 2000, 2000)


def test_quality_report_all_metrics(spark):
    names = {r["metric_name"] for r in MQ.q_quality_report(spark, SF001).collect()}
    assert {"silver_total_rows", "gold_catalog_rows", "duplicate_medicine_rows_removed",
            "missing_medicine_name_rows", "distinct_medicine_names", "unparsable_text_rows"} <= names


def test_gold_without_a_name_column(spark):
    """Without a name column the catalog is one nameless row, and the report says so."""
    silver = spark.createDataFrame([("x", "f.csv"), ("y", "f.csv"), ("z", "f.csv")], "cong_dung string, source_file string")
    catalog = M.gold_catalog(silver, with_timestamps=False).collect()
    assert [r["source_file"] for r in catalog] == ["f.csv"]
    report = {r["metric_name"]: r["metric_value"] for r in M.quality_report(silver, with_timestamps=False).collect()}
    assert (report["gold_catalog_rows"], report["duplicate_medicine_rows_removed"]) == (1, 2)
    none = {r["metric_name"]: r["metric_value"] for r in M.quality_report(silver.where("false"), with_timestamps=False).collect()}
    assert (none["gold_catalog_rows"], none["duplicate_medicine_rows_removed"]) == (0, 0)
