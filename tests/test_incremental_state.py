"""Files into the chunk index, and the bucketed silver state: replays, crashes and untouched buckets."""

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import medallion as M
from lakesmith.plans import jobs as J
from lakesmith.sources import tables as ST
from lakesmith.streaming import documents as D
from lakesmith.streaming.bucketed import BucketedState


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def put_docx(root, name, *paragraphs):
    with zipfile.ZipFile(os.path.join(root, name), "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                   f"<w:body>{body}</w:body></w:document>")


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            path = os.path.join(folder, n)
            with open(path, "rb") as f:
                out[os.path.relpath(path, root)] = hashlib.md5(f.read()).hexdigest()
    return out


def lexicon(spark):
    return spark.createDataFrame([("ginger",), ("turmeric",)], "term string")


def rows(spark, store, name, *cols):
    return sorted((tuple(r) for r in ST.read_table(spark, f"{store}/{name}").select(*cols).collect()), key=str)


def test_two_drops_with_repeats_and_rejects(spark, tmp_dir):
    landing, store, ck = (os.path.join(tmp_dir, n) for n in ("in", "store", "ck"))
    put(landing, "a/one.txt", "Ginger tea. " * 200)
    put(landing, "a/two.md", "# turmeric and GINGER\n")
    put(landing, "b/copy.TXT", "# turmeric and GINGER\n")  # the same bytes as two.md, later in path order
    put(landing, "b/sheet.csv", 'Name,Use\nginger,"cold, cough"\n\nsage,\n')
    put(landing, "b/scan.pdf", b"%PDF")
    put(landing, "b/app.exe", b"MZ")
    put(landing, "b/nothing.txt", "")
    put(landing, "b/bytes.txt", b"bad \xff byte")
    put_docx(landing, "b/doc.docx", "first", "ginger root")
    D.ingest_files(spark, landing, store, ck, lexicon(spark))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert rows(spark, store, "files", name, "status", "reason") == sorted([
        ("one.txt", "loaded", None), ("two.md", "loaded", None), ("copy.TXT", "repeated", None), ("sheet.csv", "loaded", None),
        ("scan.pdf", "rejected", "pdf text extraction not available"), ("app.exe", "rejected", "unsupported suffix"),
        ("bytes.txt", "loaded", None), ("doc.docx", "loaded", None)], key=str)
    source = F.regexp_extract("source", "([^/]+)$", 1)
    texts = {(s, n): t for s, n, t in rows(spark, store, "documents", source, "doc_no", "text")}
    assert texts["sheet.csv", 0] == "name: ginger\nuse: cold, cough" and texts["sheet.csv", 1] == "name: sage"
    assert texts["doc.docx", 0] == "first\nginger root" and texts["bytes.txt", 0] == "bad � byte" and len(texts) == 6
    tags = {(s, n, c): t for s, n, c, t in rows(spark, store, "chunks", source, "doc_no", "chunk_no", "tags")}
    assert tags["two.md", 0, 0] == "ginger,turmeric" and tags["doc.docx", 0, 0] == "ginger" and tags["bytes.txt", 0, 0] == "không xác định"
    assert tags["one.txt", 0, 0] == tags["one.txt", 0, 2] == "ginger"
    counters = [*D.STATUSES, "documents", "chunks_cut", "chunks_added"]
    assert rows(spark, store, "counters", *counters) == [(5, 1, 2, 6, len(tags), len(tags))]

    D.ingest_files(spark, landing, store, ck, lexicon(spark))  # nothing new: no batch
    assert len(rows(spark, store, "counters", *counters)) == 1
    put(landing, "c/again.txt", "Ginger tea. " * 200)
    put(landing, "c/new.txt", "nothing special")
    put(landing, "c/x.bin", b"1")
    D.ingest_files(spark, landing, store, ck, lexicon(spark))
    assert rows(spark, store, "counters", ST.BATCH_COL, *counters)[1] == (1, 1, 1, 1, 1, 1, 1)
    assert len(rows(spark, store, "chunks", "chunk_id")) == len(tags) + 1


def test_replayed_batch_changes_nothing(spark, tmp_dir):
    landing, store = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "store")
    put(landing, "a.txt", "ginger " * 400)
    put(landing, "b.txt", "ginger " * 400)
    put(landing, "c.jpg", "x")
    read = lambda names: spark.read.format("binaryFile").load([os.path.join(landing, n) for n in names])
    D.index_batch(spark, read(["a.txt", "c.jpg"]), 0, store, lexicon(spark))
    D.index_batch(spark, read(["b.txt"]), 1, store, lexicon(spark))
    tables = ("files", "documents", "chunks", "counters")
    want = {t: rows(spark, store, t, "*") for t in tables}
    for batch, names in ((1, ["b.txt"]), (0, ["a.txt", "c.jpg"]), (1, ["b.txt"])):
        D.index_batch(spark, read(names), batch, store, lexicon(spark))
        assert {t: rows(spark, store, t, "*") for t in tables} == want
    assert [r[0] for r in rows(spark, store, "counters", "repeated")] == [0, 1]


# --- bucketed state ----------------------------------------------------------------------------------

def bronze_rows(spark, start, records):
    data = [(n, d, None if n == "odd" else f"note {d}") for n, d in records]
    raw = spark.createDataFrame([(start + i, *r) for i, r in enumerate(data)], "no long, name string, lieu_dung string, note string")
    return M.to_bronze(raw, ["no"], source_file=F.lit("f.csv"), start_id=start, with_timestamps=False).drop("no")


BATCHES = [[("Sage", "6-12g"), ("mint", None), ("SAGE ", "1g"), (None, "2g"), ("thyme", "3g")],
           [("mint", "4g"), ("basil", "5g"), ("sage", "9g")],
           [("basil", None), ("odd", "x"), ("dill", "0.5kg")]]


def land(spark, bronze, upto):
    start = 1
    for i, records in enumerate(BATCHES[:upto]):
        ST.append_batch(bronze_rows(spark, start, records), bronze, i)
        start += len(records)


def silver_columns(df):
    return sorted((tuple(r) for r in df.select("name", "lieu_dung", "lieu_dung_min_g", "note", M.BRONZE_ID, M.SILVER_ID, "row_hash").collect()), key=str)


def test_bucketed_silver_equals_one_shot(spark, tmp_dir):
    bronze, state = os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "s")
    for upto in (1, 2, 3):
        land(spark, bronze, upto)
        got = silver_columns(J.run_silver_buckets(spark, bronze, state, n_buckets=8))
        whole = M.to_silver(ST.read_table(spark, bronze).drop(ST.BATCH_COL), with_timestamps=False)
        assert got == silver_columns(whole)
    files = tree(state)
    J.run_silver_buckets(spark, bronze, state, n_buckets=8)
    assert tree(state) == files  # all batches are in: nothing is written


def test_untouched_buckets_keep_their_files(spark, tmp_dir):
    state = BucketedState(spark, os.path.join(tmp_dir, "s"), "name", 16)
    first = spark.createDataFrame([(f"n{i}", i, None) for i in range(60)], "name string, cd_bronze_id long, v string")
    fold = J.fold_silver("name", ["name", "v"])
    one = state.merge(first, 0, fold, M.SILVER_ID)
    before = tree(state.path)
    two = state.merge(spark.createDataFrame([("n7", 100, "seen"), ("fresh", 101, "x")], first.schema), 1, fold, M.SILVER_ID)
    after = tree(state.path)
    assert all(after[f] == h for f, h in before.items())
    changed = {b for b in two.folders if two.folders[b] != one.folders.get(b)}
    assert len(changed) <= 2 and {f.split("/")[1] for f in after if f.startswith("v=2-") and "_bucket" in f} == {f"_bucket={b}" for b in changed}
    got = {r["name"]: (r["v"], r[M.SILVER_ID]) for r in state.read().collect()}
    assert len(got) == 61 and got["n7"] == ("seen", 8) and got["fresh"] == ("x", 61) and two.next_id == 62
    assert state.at(1).count() == 60 and state.at(1).where("v is not null").count() == 0


def test_crash_before_the_switch_leaves_the_old_version(spark, tmp_dir):
    state = BucketedState(spark, os.path.join(tmp_dir, "s"), "name", 4)
    schema = "name string, cd_bronze_id long, v string"
    fold = J.fold_silver("name", ["name", "v"])
    state.merge(spark.createDataFrame([("a", 1, None), ("b", 2, "b")], schema), 0, fold, M.SILVER_ID)
    batch = spark.createDataFrame([("a", 3, "late"), ("c", 4, "c"), (None, 5, "no name")], schema)

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        state.merge(batch, 1, fold, M.SILVER_ID, before_switch=crash)
    assert state.version().number == 1 and sorted((r["name"], r["v"]) for r in state.read().collect()) == [("a", None), ("b", "b")]
    state.merge(batch, 1, fold, M.SILVER_ID)
    want = [("a", "late", 1), ("b", "b", 2), ("c", "c", 3)]
    assert sorted((r["name"], r["v"], r[M.SILVER_ID]) for r in state.read().collect()) == want
    files = tree(state.path)
    assert state.merge(batch, 1, fold, M.SILVER_ID).number == 2 and tree(state.path) == files
    stale = BucketedState(spark, state.path, "name")
    stale.version = lambda: type(state.version())(1, 4, 0, 3, {})  # a writer that has not seen version 2
    with pytest.raises(RuntimeError):
        stale.merge(spark.createDataFrame([("z", 9, "z")], schema), 7, fold, M.SILVER_ID)
    assert sorted((r["name"], r["v"], r[M.SILVER_ID]) for r in state.read().collect()) == want
