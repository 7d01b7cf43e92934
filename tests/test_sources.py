"""File sources and incremental ingestion on trees generated with the stdlib."""

import csv
import os
import zipfile

from pyspark.sql import functions as F

from lakesmith.operators.medallion import BRONZE_ID
from lakesmith.sources import files as SF
from lakesmith.sources import tables as ST
from lakesmith.streaming import ingest as IN

SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_xlsx(path, rows_xml, shared=("Tên", "bạc hà")):
    sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml",
                   f'<workbook {SHEET_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   '<sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="B" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {SHEET_NS}>{sst}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {SHEET_NS}><sheetData>{rows_xml}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml",
                   f'<worksheet {SHEET_NS}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>ignored</t></is></c></row>'
                   "</sheetData></worksheet>")


ROWS = ('<row r="1"></row>'                                                     # blank row before the header
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>Flag</t></is></c>'
        '<c r="AA2" t="inlineStr"><is><t>Far</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="AA3"><v> 7 </v></c></row>'
        '<row r="4"><c r="A4" t="inlineStr"><is><t>x</t></is></c><c r="C4" t="b"><v>0</v></c></row>')


def test_xlsx_rows(tmp_dir):
    p = os.path.join(tmp_dir, "a.xlsx")
    write_xlsx(p, ROWS)
    rows = SF.xlsx_rows(open(p, "rb").read())
    assert rows[1][0] == "Tên" and rows[1][1] == "" and rows[1][2] == "Flag" and len(rows[1]) == 27
    assert rows[2][2] == "true" and rows[3][2] == "false"


def test_read_xlsx_files(spark, tmp_dir):
    write_xlsx(os.path.join(tmp_dir, "a.xlsx"), ROWS)
    df = SF.read_xlsx_files(spark, spark.read.format("binaryFile").load(tmp_dir))
    rows = sorted(df.select("t_n", "col_2", "flag", "far").collect(), key=lambda r: r["t_n"])
    assert [(r["t_n"], r["col_2"], r["flag"], r["far"]) for r in rows] == [
        ("bạc hà", "", "true", "7"), ("x", "", "false", "")]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_csv_header_over_several_lines(spark, tmp_dir):
    """A header record ends where its last quoted cell closes; no column is lost."""
    path = os.path.join(tmp_dir, "q.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('\n"Tên\nthuốc","a ""b""\n\nc",d\n1,2,3\n"4\n4",5,6\n')
    df = SF.read_csv_files(spark, [path])
    assert df.columns[:3] == ["t_n_thu_c", "a_b_c", "d"]
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("1", "2", "3"), ("4\n4", "5", "6")]


def test_load_documents_without_accepted_files(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.bin"), "w") as f:
        f.write("x")
    docs, rejected = SF.load_documents(spark, tmp_dir)
    assert docs.count() == 0 and rejected.count() == 1


def test_csv_headers_and_schema_union(spark, tmp_dir):
    write_csv(os.path.join(tmp_dir, "a.csv"), ["Tên cây thuốc", "a", "A", ""], [["x", "1", "2", "3"], ["y\nz", "4", "5", "6"]])
    write_csv(os.path.join(tmp_dir, "b.CSV"), ["Tên cây thuốc", "extra"], [["w", "e"]])
    open(os.path.join(tmp_dir, "skip.txt"), "w").write("nope")
    paths = [r.path for r in SF.list_files(spark, tmp_dir).collect()]
    assert len(paths) == 2
    df = SF.read_csv_files(spark, paths)
    assert {"t_n_c_y_thu_c", "a", "a_2", "col_4", "extra"} <= set(df.columns)
    got = sorted((r["t_n_c_y_thu_c"], r["a_2"], r["extra"]) for r in df.collect())
    assert got == [("w", None, "e"), ("x", "2", None), ("y\nz", "5", None)]


def test_documents_dispatch(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "sub"))
    open(os.path.join(tmp_dir, "a.txt"), "w").write("hello\nworld")
    open(os.path.join(tmp_dir, "sub", "b.md"), "w").write("# title")
    open(os.path.join(tmp_dir, "c.pdf"), "wb").write(b"%PDF")
    open(os.path.join(tmp_dir, "d.bin"), "wb").write(b"x")
    with zipfile.ZipFile(os.path.join(tmp_dir, "e.docx"), "w") as z:
        z.writestr("word/document.xml",
                   '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
                   "<w:p><w:r><w:t>Para </w:t></w:r><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p>"
                   "</w:body></w:document>")
    write_csv(os.path.join(tmp_dir, "f.csv"), ["k", "v"], [["1", "x"]])
    docs, rejected = SF.load_documents(spark, tmp_dir)
    texts = sorted(r["text"] for r in docs.collect())
    assert texts == ["# title", "Para one\ntwo", "hello\nworld", "k: 1\nv: x"]
    assert sorted(os.path.basename(r["path"]) for r in rejected.collect()) == ["c.pdf", "d.bin"]


def test_bronze_stream_is_idempotent(spark, tmp_dir):
    landing, table, ck = (os.path.join(tmp_dir, n) for n in ("in", "bronze", "ck"))
    os.makedirs(landing)
    write_csv(os.path.join(landing, "a.csv"), ["Name", "Dose"], [["x", "6-12g"]])
    IN.ingest_bronze(spark, landing, table, ck)
    IN.ingest_bronze(spark, landing, table, ck)
    assert ST.read_table(spark, table).count() == 1
    write_csv(os.path.join(landing, "b.csv"), ["Name", "Dose"], [["y", "5"], ["z", "1"]])
    IN.ingest_bronze(spark, landing, table, ck)
    IN.ingest_bronze(spark, landing, table, ck)
    rows = ST.read_table(spark, table).orderBy(BRONZE_ID).collect()
    assert [r[BRONZE_ID] for r in rows] == [1, 2, 3] and [r["name"] for r in rows] == ["x", "y", "z"]


def test_append_batch_replay(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    ST.append_batch(a, p, 0)
    ST.append_batch(spark.createDataFrame([(2, 5)], "k long, b int"), p, 1)
    ST.append_batch(a, p, 0)
    df = ST.read_table(spark, p)
    assert df.count() == 2 and {"a", "b"} <= set(df.columns)


def test_jobs_end_to_end(spark, tmp_dir):
    """M1 -> M2 -> M3 over two CSV drops: ids stay stable across runs."""
    from lakesmith.plans import jobs as J
    landing, bronze, ck, silver, gold = (os.path.join(tmp_dir, n) for n in ("in", "b", "ck", "s", "g"))
    os.makedirs(landing)
    write_csv(os.path.join(landing, "a.csv"), ["Tên cây thuốc", "Liều dùng", "Tính vị quy kinh"],
              [["Bạc hà", "6-12g", "Vị cay, tính mát. Vào kinh phế."], ["Gừng", "", "Vị cay"]])
    J.run_bronze(spark, landing, bronze, ck)
    first = {r["t_n_c_y_thu_c"]: r["cd_silver_id"] for r in J.run_silver(spark, bronze, silver,
             name_candidates=("t_n_c_y_thu_c",), dose_col="li_u_d_ng").collect()}
    write_csv(os.path.join(landing, "b.csv"), ["Tên cây thuốc", "Liều dùng"], [["Atiso", "10 - 20 g"], ["gừng", "3g"]])
    J.run_bronze(spark, landing, bronze, ck)
    rows = J.run_silver(spark, bronze, silver, name_candidates=("t_n_c_y_thu_c",), dose_col="li_u_d_ng").collect()
    second = {r["t_n_c_y_thu_c"]: r["cd_silver_id"] for r in rows}
    assert {k: second[k] for k in first} == first and second["atiso"] == 3
    ginger = next(r for r in rows if r["t_n_c_y_thu_c"] == "gừng")
    assert ginger["li_u_d_ng"] == "3g" and ginger["li_u_d_ng_min_g"] == 3.0
    paths = J.run_gold(spark, silver, gold, roles={"medicine_name": "t_n_c_y_thu_c"})
    assert set(paths) == {"medicine_catalog", "medicine_search", "medicine_stats", "quality_report"}
    assert ST.read_table(spark, paths["medicine_catalog"]).count() == 3


def test_index_and_retrieve(spark):
    from lakesmith.plans import jobs as J
    from lakesmith.plans import retrieval_queries as RQ
    from conftest import SF001
    idx = J.build_index(RQ.docs(spark, SF001).orderBy("doc_id").limit(200), RQ.herb_lexicon(spark, SF001))
    from lakesmith.operators import retrieval as R
    terms = R.query_terms(RQ.questions(spark, SF001), "query_id")
    hits = R.bm25_topk(idx["postings"], terms).withColumnRenamed("doc_id", "chunk_uid")
    scored = hits.join(idx["chunks"].select("chunk_uid", "text", "source"), "chunk_uid").withColumn("entity_score", F.lit(0))
    out = J.retrieve(RQ.questions(spark, SF001), scored).collect()
    assert len(out) == 40 and all((r["gate"] == "answer") == (r["n_docs"] > 0) for r in out)


def test_replayed_batch_is_exact(spark, tmp_dir):
    """A micro-batch replayed after its write (commit lost) rewrites the same rows and ids."""
    from lakesmith.operators.retrieval import upsert_new
    idx = os.path.join(tmp_dir, "idx")
    rows0 = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, doc_id long")
    rows1 = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, doc_id long")

    def run(batch_id, rows):
        old = IN.existing(spark, idx, before_batch=batch_id)
        ST.append_batch(upsert_new(old if old is not None else rows.limit(0), rows, "chunk_id", ["doc_id"]),
                        idx, batch_id)

    run(0, rows0)
    run(1, rows1)
    first = sorted(map(tuple, ST.read_table(spark, idx).select("chunk_id", "doc_id").collect()))
    run(1, rows1)  # replay of batch 1
    again = sorted(map(tuple, ST.read_table(spark, idx).select("chunk_id", "doc_id").collect()))
    assert first == again == [("a", 1), ("b", 2), ("c", 4)]


def test_header_search_is_bounded(spark, tmp_dir):
    """A stray quote in the header is an error after a bounded number of lines; a header of some lines is read."""
    import pytest
    good, bad = os.path.join(tmp_dir, "good.csv"), os.path.join(tmp_dir, "bad.csv")
    with open(good, "w") as f:
        f.write('"a\n' + "x\n" * 40 + '",b\n1,2\n')
    with open(bad, "w") as f:
        f.write('"a,b\n' + "1,2\n" * 3000)
    rows = SF.read_csv_files(spark, [good])
    assert rows.count() == 1 and rows.first()["b"] == "2"
    with pytest.raises(ValueError, match="bad.csv"):
        SF.read_csv_files(spark, [bad])


def test_text_files_are_written_by_all_cores_without_side_files(spark, tmp_dir):
    """One row group of documents: a file per key and nothing beside it, the rows of a key as its lines, a null text as an empty line."""
    rows = [(i, f"text {i}\nsecond line") for i in range(300)] + [(7, "again"), (8, None), (None, "no key"), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    SF.write_text_files(df, f"{tmp_dir}/t", F.concat(F.lit("a/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = {os.path.relpath(os.path.join(at, f), f"{tmp_dir}/t") for at, _, files in os.walk(f"{tmp_dir}/t") for f in files}
    assert found == {f"a/{i}.txt" for i in [*range(300), 301, "none"]}
    docs, rejected = SF.load_documents(spark, f"{tmp_dir}/t")
    texts = {os.path.basename(r["source"]): r["text"] for r in docs.collect()}
    assert texts["7.txt"] == "text 7\nsecond line\nagain\n" and texts["8.txt"] == "text 8\nsecond line\n\n" and texts["301.txt"] == "\n" and texts["none.txt"] == "no key\n"
    assert len(texts) == 302 and rejected.count() == 0


def test_text_documents_writes_a_file_per_document_in_few_folders(spark, tmp_path):
    """The tree of text_documents holds one file a document and nothing else, below a bounded number of folders."""
    from lakesmith.plans import ingest_queries as Q
    from lakesmith.session import checkpoint_root
    (tmp_path / "d").mkdir()
    spark.range(1000).selectExpr("id AS doc_id", "concat('t', id) AS text").write.parquet(str(tmp_path / "d" / "documents.parquet"))
    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    got = Q.q_text_documents(spark, str(tmp_path / "d"))
    assert {tuple(r) for r in got.collect()} == {(i, f"t{i}") for i in range(1000)}
    landing = next(x for x in set(os.listdir(root)) - before if x.startswith("landing_text"))
    walked = list(os.walk(f"{root}/{landing}"))
    assert sum(len(files) for _, _, files in walked) == 1000 and len(walked) <= Q.TEXT_FOLDERS + 1


def _odd_tree(root: str) -> None:
    names = ["a b.txt", "p%20q.txt", "é ü .TXT", "h#q?.md", "[x]{y}^`|\\.txt", "a;b,c=d&e+f@g$h!i'j(k)*~.txt", '"<>.txt', "_hid/x.txt", "_k=v/x.txt", ".dot/x.txt", "_y.txt",
             ".z.txt", "c._COPYING_", "_metadata.txt", "_metadata_d/x.txt", "dir.txt/in.md", "noext", "x.pdf", "日本/　.txt", "tab\t.txt", "_metadata=1.txt", "deep/er/and/er.txt"]
    for name in names:
        at = os.path.join(root, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(f"{name}\n")
    with open(f"{root}/bytes.txt", "wb") as f:
        f.write(b"\xff\x00\r\n\xc3")
    open(f"{root}/empty.txt", "w").close()
    os.makedirs(f"{root}/no files")
    os.symlink(f"{root}/a b.txt", f"{root}/link.txt")
    os.symlink(f"{root}/_k=v", f"{root}/linked")
    os.symlink(f"{root}/nowhere", f"{root}/broken.txt")


def test_tree_listed_by_tasks_is_that_of_sparks_reader(spark, tmp_dir):
    """Odd names, hidden, empty and linked files: paths, lengths, URIs and bytes are those of ``binaryFile``, for a path and for a URI."""
    root = f"{tmp_dir}/tree x%20/é"
    _odd_tree(root)
    wanted = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for at in (root, f"file:{root}", f"file://{root}/"):
        listed, contents = SF._arrow_tree(spark, *SF._arrow_folder(spark, at))
        assert rows(listed) == rows(wanted.select("path", "length")) and listed.count() == 19
        for ext in (".txt", ".md", ".pdf"):
            of = wanted.where(SF.extension() == ext)
            assert rows(contents(ext, 1, 1).select("path", "source", F.hex("content"))) == rows(of.select("path", "_metadata.file_path", F.hex("content")))
    docs, rejected = SF.load_documents(spark, root)
    texts = wanted.where(SF.extension().isin(".txt", ".md")).select("_metadata.file_path", F.hex("content"))
    assert rows(docs.select("source", F.hex(F.col("text").cast("binary")))) == rows(texts)
    assert {os.path.basename(r["path"]) for r in rejected.collect()} == {"noext", "x.pdf"}


def test_trees_that_arrow_does_not_know_are_read_by_spark(spark, tmp_dir):
    """A pattern, a single file and another file system; nothing there is Spark's error."""
    import pytest
    from pyspark.errors import AnalysisException
    _odd_tree(f"{tmp_dir}/t")
    assert SF._arrow_folder(spark, f"{tmp_dir}/t/de*") is None and SF._arrow_folder(spark, f"{tmp_dir}/t/noext") is None
    docs, _ = SF.load_documents(spark, f"{tmp_dir}/t/de*")
    assert [r["text"] for r in docs.collect()] == ["deep/er/and/er.txt\n"]
    docs, rejected = SF.load_documents(spark, f"{tmp_dir}/t/noext")
    assert docs.count() == 0 and rejected.count() == 1
    with pytest.raises(AnalysisException):
        SF.load_documents(spark, f"{tmp_dir}/none")


def test_text_documents_keeps_no_entry_of_a_file_on_the_driver(spark, tmp_path):
    """What the driver knows of the loaded tree (the files of the relations in the plan) does not grow with the documents."""
    from lakesmith.plans import ingest_queries as Q
    (tmp_path / "d").mkdir()
    spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text").write.parquet(str(tmp_path / "d" / "documents.parquet"))
    got = Q.q_text_documents(spark, str(tmp_path / "d"))
    assert len(got.inputFiles()) <= SF.READ_TASKS_PER_CORE * spark.sparkContext.defaultParallelism + 1
    assert {tuple(r) for r in got.collect()} == {(i, f"t{i}") for i in range(3000)}


def test_large_files_go_to_batches_of_bounded_bytes(spark, tmp_dir, monkeypatch):
    """Files are read whole whatever the bounds of a batch, and a folder of more files than a batch holds is listed whole."""
    monkeypatch.setattr(SF, "BATCH_FILES", 3)
    monkeypatch.setattr(SF, "BATCH_BYTES", 10)
    texts = {f"{i}.txt": chr(97 + i) * (1 + 4 * i) for i in range(11)}
    for name, text in texts.items():
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    docs, _ = SF.load_documents(spark, tmp_dir)
    assert {os.path.basename(r["source"]): r["text"] for r in docs.collect()} == texts and docs.count() == 11


def test_text_files_hold_long_short_and_repeated_texts_whole(spark, tmp_dir):
    """Texts that pack well, badly or not at all, many lines of one file in order, and any characters."""
    rows = [(1, 2, "ab" * 500_000), (1, 1, ""), (1, 3, "x"), (2, 1, "é\u0000\r\n日本 \U0001f33f"), (2, 2, None), *[(3, i, f"line {i} " * 20) for i in range(40)]]
    df = spark.createDataFrame(rows, "k long, i long, text string")
    SF.write_text_files(df, f"{tmp_dir}/t", F.concat(F.col("k").cast("string"), F.lit(".txt")), order=["i"])
    for k in (1, 2, 3):
        with open(f"{tmp_dir}/t/{k}.txt", "rb") as f:
            assert f.read() == "".join(f"{text or ''}\n" for key, _, text in sorted(rows, key=lambda r: r[:2]) if key == k).encode()


def test_texts_are_packed_for_the_shuffle_of_the_writer(spark, tmp_dir, monkeypatch):
    """What is dealt out by file is less than half of plain text of few words, and unpacked again in the file."""
    import random
    words, draw = [f"word{i:04d}" for i in range(300)], random.Random(7)
    rows = [(i, " ".join(draw.choices(words, k=600))) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, text string")
    dealt, real = [], type(df).repartition

    def repartition(self, *args):
        if "line" in self.columns:
            dealt.append(self.select(F.sum(F.length("line"))).first()[0])
        return real(self, *args)

    monkeypatch.setattr(type(df), "repartition", repartition)
    SF.write_text_files(df, f"{tmp_dir}/t", F.concat(F.col("k").cast("string"), F.lit(".txt")))
    monkeypatch.undo()
    assert len(dealt) == 1 and dealt[0] < sum(len(t) for _, t in rows) / 2
    docs, _ = SF.load_documents(spark, f"{tmp_dir}/t")
    assert {r["text"] for r in docs.collect()} == {f"{t}\n" for _, t in rows}
