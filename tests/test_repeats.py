"""Expiring state on a stream gives the hits of the whole, however the rows are split."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesmith.sources import tables as ST
from lakesmith.streaming.ingest import _run
from lakesmith.streaming.repeats import lives, seen_within

SCHEMA = "id long, key string, at timestamp, extra string"
TTL = 60


def rows():
    """Ascending times; a hot key, ties, gaps below, at and above the ttl, null keys and times."""
    rng = np.random.default_rng(9)
    out, t = [], 1_700_000_000
    for i in range(240):
        t += int(rng.choice([0, 1, 5, 30]))
        key = "hot" if rng.random() < 0.35 else f"k{int(rng.integers(0, 12))}"
        out.append((i, key, t))
    out += [(900, "edge", t), (901, "edge", t + TTL), (902, "edge", t + 2 * TTL - 1), (903, None, t), (904, "late", None)]
    return sorted(out, key=lambda r: (r[2] is None, r[2] or 0, r[0]))


def plain(data):
    last, want = {}, []
    for i, key, t in data:
        if key is None or t is None:
            continue
        hit = key in last and t - last[key][0] < TTL
        last[key] = (t, last[key][1] + 1 if hit else 1)
        want.append((i, key, hit, last[key][1]))
    return sorted(want)


@pytest.mark.parametrize("cuts", [[], [120], [1, 7, 8, 100, 101, 230]])
def test_any_split_gives_the_same_hits(spark, tmp_dir, cuts):
    data = rows()
    landing, out, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    bounds = [0, *cuts, len(data)]
    for a, b in zip(bounds, bounds[1:]):
        part = spark.createDataFrame([(i, k, t, "x") for i, k, t in data[a:b]], "id long, key string, t long, extra string")
        part.select("id", "key", F.timestamp_seconds("t").alias("at"), "extra").orderBy(F.rand(3)).coalesce(2).write.mode("append").parquet(landing)
        stream = seen_within(spark.readStream.schema(SCHEMA).parquet(landing), "key", "at", ["id"], TTL)
        _run(stream, ck, lambda batch, n: ST.append_batch(batch, out, n))
    got = sorted((r["id"], r["key"], r["hit"], r["times"]) for r in ST.read_table(spark, out).collect())
    assert got == plain(data)


def test_lives_across_a_state():
    t = np.array([100, 130, 200, 201])
    hit, times = lives(t, 50, 4, 60)
    assert hit.tolist() == [True, True, False, True] and times.tolist() == [5, 6, 1, 2]
    hit, times = lives(t, None, 0, 60)
    assert hit.tolist() == [False, True, False, True] and times.tolist() == [1, 2, 1, 2]


def test_many_keys_share_a_few_states(spark, tmp_dir):
    """State and Python calls go by bucket, not by key, and the hits stay those of every key on its own."""
    data = [(i, f"k{i * 7 % 300}", 1_700_000_000 + i // 6) for i in range(1500)]
    landing, out, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    for a, b in ((0, 700), (700, 1500)):
        part = spark.createDataFrame(data[a:b], "id long, key string, t long")
        part.select("id", "key", F.timestamp_seconds("t").alias("at")).write.mode("append").parquet(landing)
        stream = seen_within(spark.readStream.schema("id long, key string, at timestamp").parquet(landing), "key", "at", ["id"], TTL, buckets=3)
        _run(stream, ck, lambda batch, n: ST.append_batch(batch, out, n))
    got = sorted((r["id"], r["key"], r["hit"], r["times"]) for r in ST.read_table(spark, out).collect())
    assert got == plain(data)
    assert spark.read.format("statestore").load(ck).count() == 3
