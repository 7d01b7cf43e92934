"""Fixed chunks of long texts and file states of a batch, against plain Python."""

import hashlib
import time

from pyspark.sql import functions as F

from lakesmith.operators import chunking as C
from lakesmith.streaming import documents as D
from lakesmith.streaming import ingest as IN


def _plain(text, size, step):
    out, i = [], 0
    while True:
        out.append((i, i * step, text[i * step:i * step + size]))
        if i * step + size >= len(text):
            return out
        i += 1


def test_windows_of_all_lengths(spark):
    texts = ["aβ€😀x\n"[k % 6] * k + "end😀" for k in range(0, 400, 7)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((10, 3), (7, 0), (50, 49)):
        got = {(r["doc_id"], r["chunk_no"], r["chunk_start"], r["chunk_text"]) for r in C.chunk_fixed(df, size=size, overlap=overlap).collect()}
        assert got == {(i, *w) for i, t in enumerate(texts) if t for w in _plain(t, size, size - overlap)}


def test_a_long_text_is_not_walked_from_its_start_for_every_window(spark, tmp_path):
    """17 MB in one text: some 20,000 windows took a walk of 8 MB each."""
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "a.txt").write_text("ä23456789 bcdefg\n" * 1_000_000, encoding="utf-8")
    df = spark.read.text(str(tmp_path / "long"), wholetext=True).select(F.lit(1).cast("long").alias("doc_id"), F.col("value").alias("text"))
    start = time.time()
    n, chars = C.chunk_fixed(df).agg(F.count("chunk_no"), F.sum(F.length("chunk_text"))).first()
    windows = 1 + -(-(17_000_000 - 1200) // 850)
    assert n == windows and chars == (windows - 1) * 1200 + 17_000_000 - (windows - 1) * 850
    assert time.time() - start < 30


def test_file_states_read_the_contents_once(spark):
    rows = [("d/b.txt", 1, b"x"), ("d/a.txt", 1, b"x"), ("d/a.json", 1, b"x"), ("d/c.txt", 1, b"y"), ("d/k.md", 1, b"z"), ("d/p.pdf", 1, b"y")]
    batch = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, length long, content binary")
    earlier = spark.createDataFrame([(hashlib.md5(b"z").hexdigest(), "loaded"), (hashlib.md5(b"y").hexdigest(), "rejected")], "etag string, status string")
    got = D.file_states(batch, earlier)
    assert {(r["path"], r["status"]) for r in got.collect()} == {
        ("d/a.txt", "loaded"), ("d/b.txt", "repeated"), ("d/a.json", "rejected"), ("d/c.txt", "loaded"), ("d/k.md", "repeated"), ("d/p.pdf", "rejected")}
    plan = D.file_states(batch, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_a_micro_batch_lists_its_files_in_few_tasks(spark, tmp_path):
    """Within a run the listing has a bounded number of tasks; afterwards the session is as it was."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    seen, before = [], spark.conf.get(IN.LISTING_TASKS)
    stream = spark.readStream.format("text").load(str(tmp_path / "in"))
    IN._run(stream, str(tmp_path / "ck"), lambda batch, batch_id: seen.append(int(spark.conf.get(IN.LISTING_TASKS))))
    assert seen == [2 * spark.sparkContext.defaultParallelism] and spark.conf.get(IN.LISTING_TASKS) == before
