"""Single faults that reviews found in the operators, each with the rows that showed it."""

import os
import subprocess
import sys
import textwrap

import numpy as np
from pyspark.sql import functions as F

from lakesmith.llm import decontaminate, langid, mixing, ranking

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_labelled_row_is_in_a_pair():
    for bad, good in ((700, 1000), (7000, 8000), (490, 500), (1, 9), (9, 1), (14, 14), (3, 100)):
        label = np.array([0] * bad + [1] * good)
        g, b = ranking.preference_pairs(label, 4)
        assert set(g) | set(b) == set(range(bad + good)) and (label[g] == 1).all() and (label[b] == 0).all()
        assert len(g) == 4 * max(good, bad)


def test_scores_clip_features_as_the_fit_does(spark):
    r = ranking.Ranker((0.0, 1.0), (1.0, 2.0), (1.0, -1.0), 0.0, 1.0, 0.3)
    rows = spark.createDataFrame([([1.0, 3.0],), ([1e6, 1.0],), ([-1e6, 1e9],)], "x array<double>")
    assert [round(x[0], 9) for x in rows.select(r.strength(F.col("x"))).collect()] == [0.0, 8.0, -16.0]


def test_language_sample_counts_repeated_rows_once(spark):
    """One row 300 times, and string ids."""
    a, b = "the cat sat on the mat and saw the dog ", "der hund und die katze sind im garten "
    rows = [("same", "en", a * 3)] * 300 + [(f"e{i}", "en", a + f"run {i} fast" * (i % 5)) for i in range(40)]
    rows += [(f"d{i}", "de", b + f"lauf {i} schnell" * (i % 5)) for i in range(40)] + [(None, "de", b)]
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    model = langid.fit(docs, fit_rows=20)
    once = langid.fit(docs.dropDuplicates(), fit_rows=20)
    assert model.langs == once.langs and set(model.langs) == {"de", "en"}
    got = {(r["lang_pred"], r["doc_id"][0]) for r in langid.predict(docs.where("doc_id is not null"), model).collect()}
    assert got == {("en", "s"), ("en", "e"), ("de", "d")}


def test_short_items_at_their_own_length(spark):
    docs = spark.createDataFrame([(1, "we say alpha beta here"), (2, "alpha"), (3, "beta alpha"), (4, None), (5, "x alpha\nbeta gamma y"), (6, "alpha beta"),
                                  (6, "alpha beta"), (7, "and alpha"), (8, "beta and")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha beta"), (11, "alpha\tbeta gamma"), (12, "gamma"), (13, ""), (None, "gamma"), (14, "alpha beta")],
                                  "item_id long, text string")
    found = lambda **kw: sorted(((r["id"], r["item"], r["shared"], r["item_shingles"]) for r in decontaminate.find_items(docs, items, **kw).collect()), key=str)
    want = [(d, i, 1, 1) for d in (1, 5, 6, 6) for i in (10, 14)] + [(5, 11, 1, 1), (5, 12, 1, 1), (5, None, 1, 1)]
    assert found() == found(block_shingles=2) == sorted(want, key=str)
    assert found(short_items=False) == []


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    for kind in ("decimal(12,2)", "smallint", "string", "date"):
        key = F.lit("2020-01-02").cast("date") if kind == "date" else F.lit(7).cast(kind)
        items = docs.select(key.alias("item_id"), F.lit(" ".join(f"w{i}" for i in range(3, 20))).alias("text"))
        got = decontaminate.find_items(docs, items).collect()
        assert [(r["id"], r["shared"]) for r in got] == [(1, 13)] and got[0]["item"] == items.first()["item_id"]


def test_mix_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "old", 9) for i in range(4)], "doc_id long, text string, source string, position string, epoch int")
    got = mixing.curriculum(docs)
    assert got.columns == ["doc_id", "text", "source", "epoch", "position"] and dict(got.dtypes)["position"] == "double"
    assert got.count() == 4


def test_workers_without_the_package(tmp_path):
    """Class scores and decontamination from a folder in which workers cannot import the package."""
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from lakesmith.session import build_session
        from lakesmith.llm import classlm, decontaminate
        from pyspark.sql import functions as F
        spark = build_session("local[2]", 2)
        docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine")], "doc_id long, text string")
        def blind(batches):
            for b in batches:
                try:
                    import lakesmith.llm.classlm
                    raise SystemExit("the package is visible to workers")
                except ImportError:
                    yield b
        assert docs.mapInPandas(blind, docs.schema).count() == 2
        items = docs.where("doc_id = 1").withColumnRenamed("doc_id", "item_id")
        print("FOUND", decontaminate.find_items(docs, items).count(), classlm.score(docs, F.lit(True)).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "FOUND 1 2" in out.stdout, out.stdout[-2000:] + out.stderr[-3000:]
