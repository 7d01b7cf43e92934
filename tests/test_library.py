"""Library functions not exercised directly by a registered query."""

import os

from pyspark.sql import functions as F

from lakesmith.operators import conversations as CV
from lakesmith.operators import medallion as M
from lakesmith.sources import tables as ST
from lakesmith.streaming import ingest as IN

from conftest import SF001


def test_rolling_memory_last_20_in_order(spark):
    pairs = CV.qa_pairs(spark.read.parquet(f"{SF001}/conversations.parquet"))
    msgs = CV.unpivot_messages(pairs)
    mem = CV.rolling_memory(msgs, n=20)
    per = {r["conv_id"]: r["c"] for r in mem.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    tot = {r["conv_id"]: r["c"] for r in msgs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert all(per[c] == min(20, tot[c]) for c in tot)
    one = max(tot, key=tot.get)
    rows = sorted(mem.where(F.col("conv_id") == one).collect(), key=lambda r: r["pos"])
    keys = [(r["turn"], r["msg_no"]) for r in rows]
    assert keys == sorted(keys) and [r["pos"] for r in rows] == list(range(1, len(rows) + 1))


def test_unprocessed_batches(spark):
    src = spark.createDataFrame([(1, "0"), (2, "1"), (3, "2")], "x long, _batch_id string")
    done = spark.createDataFrame([("0",), ("1",)], "_batch_id string")
    assert [r["x"] for r in IN.unprocessed_batches(src, done).collect()] == [3]
    assert IN.unprocessed_batches(src, None).count() == 3


def test_register_and_list_tables(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    assert ST.write_counted(spark.range(5), p) == 5
    name = ST.register_table(spark, "lakesmith_test", "numbers", p, os.path.join(tmp_dir, "db"))
    assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == 5
    assert "numbers" in ST.list_tables(spark, "lakesmith_test")


def test_merge_into_equals_one_shot(spark):
    part = IN.normalized_names(spark.read.parquet(f"{SF001}/part.parquet"), "p_name")
    cols = ["p_brand", "p_type", "p_size", "p_retailprice"]
    state = None
    for lo, hi in ((0, 700), (700, 1400), (1400, 10_000)):
        state = IN.merge_into(state, part.where((F.col("p_partkey") >= lo) & (F.col("p_partkey") < hi)),
                              "p_name", "p_partkey", cols)
    one = M.merge_by_name(part, "p_name", "p_partkey", cols)
    assert state.exceptAll(one.select(*state.columns)).count() == 0 and state.count() == one.count()


def test_stable_ids(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, ord long")
    ids = IN.assign_stable_ids(a, None, "name", ["ord"], "id")
    b = spark.createDataFrame([("z", 0), ("y", 2), ("x", 1)], "name string, ord long")
    ids2 = {r["name"]: r["id"] for r in IN.assign_stable_ids(b, ids, "name", ["ord"], "id").collect()}
    assert ids2 == {"x": 1, "y": 2, "z": 3}
