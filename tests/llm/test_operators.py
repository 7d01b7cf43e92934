"""Operators of the training-data subpackage on a small fixture with nulls, blank and long texts,
ties, repeated rows, empty tables and columns of clashing names, against plain-Python versions."""

import math
import hashlib
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as P
from lakesmith.llm import chat, classlm, decontaminate, langid, linededup, mixing, neardup, ranking, rules, warc
from lakesmith.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, d int, w string"
BASE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"x{i % 997}y{i}" for i in range(20000))
TEXTS = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("word30", "other")), (4, None), (5, ""), (6, " \t\n"),
         (7, "a b c"), (8, "a b c"), (9, LONG), (None, "null id " + BASE), (10, "one two three\n\none two three\nfour five"),
         (11, " ".join(["spam ham eggs toast jam"] * 6)), (12, "## $$ %% " * 20), (13, "é ñ ü ß " * 12),
         (14, "same head of a line that goes on to here\nlast"), (15, "same head of a line that goes off to here\nlast"),
         (16, "same head of a line that goes to here")]


def fixture(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None, 0, "k", 1, "w") for i, t in texts], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def shingles(t, short=True):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w and short else set())


def test_stats_match_plain_counts(spark):
    got = rules.with_stats(fixture(spark).select("doc_id", F.col("text").alias("t0"), F.col("text").alias("t")), "t").collect()
    for r in got:
        t, w, s = r["t0"] or "", words(r["t0"]), r["__stats"]
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set()
        inside = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (s["w"]["n_words"], s["w"]["word_chars"], s["w"]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))
        assert s["l"]["n_dup_lines"] == len(lines) - len(set(lines))
        assert s["c"]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)


def test_rules_learn_a_separating_threshold(spark):
    df = spark.range(900).select("id", (F.col("id") % 5 != 0).cast("int").alias("y"), F.when(F.col("id") % 5 == 0, 0.3 + F.col("id") / 9000)
                                 .otherwise(F.col("id") / 90000).alias("symbol_ratio"), F.rand(1).alias("words"))
    learnt = rules.learn_rules(df, "y", "id", features=("symbol_ratio", "words"))
    assert len(learnt) == 1 and learnt[0][0].feature == "symbol_ratio" and 0.009 < learnt[0][0].threshold < 0.32
    assert df.where(rules.verdict(learnt) != (F.col("y") == 1)).count() <= 2
    assert rules.learn_rules(df.where("y = 1"), "y", "id", features=("words",)) == []


def test_line_dedup_rearranged_witness(spark):
    """An earlier rearrangement with the same neighbouring words does not hide a true witness."""
    one, two = "s v a b v c d v e", "s v c d v a b v e"
    docs = fixture(spark, [(1, two), (2, one), (3, one + " z"), (4, two + " z"), (5, "s v a b v c d e"), (6, "s v c d v a b v x")])
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert got == {1: two, 2: one, 3: "", 4: "", 5: "", 6: ""}


def test_line_dedup_matches_brute_force(spark):
    docs = fixture(spark)
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["key"]) for r in linededup.drop_repeated_lines(docs).collect())

    def near(a, b):
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    seen, want = [], []
    for i, t in sorted({(i or -1, t or "") for i, t in TEXTS}):
        kept = []
        for no, line in enumerate(t.split("\n")):
            w = words(line)
            if w and any(w == s or near(w, s) for s in seen):
                continue
            if w:
                seen.append(w)
            kept.append(line)
        want += [(i, "\n".join(kept), "k")] * sum((x or -1, y or "") == (i, t) for x, y in TEXTS)
    # a line goes if ANY earlier line matches, kept or not: the fixture has no chains, so both rules agree
    assert got == sorted(want)


def test_near_duplicates_match_brute_force(spark):
    got = {(r["doc_id"], r["class_id"], r["copy_id"], r["n_links"]) for r in neardup.near_duplicates(fixture(spark)).collect()}
    sets = [(i, shingles(t)) for i, t in TEXTS]
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    want = {(i, sum(jac(s, o) >= 0.8 for k, (_, o) in enumerate(sets) if k != n)) for n, (i, s) in enumerate(sets)}
    assert {(g[0], g[3]) for g in got} == want
    by = {g[0]: g for g in got}
    assert by[3][1] == by[1][1] == by[2][1] == 1 and by[2][2] == 1 and by[8][1] == 7 and by[5][1] == 5


def test_large_near_group_splits_into_blocks(spark):
    rows = [(i, BASE + f" tail{i} end{i}") for i in range(700)]
    got = neardup.near_duplicates(fixture(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {699}


def test_decontamination_matches_brute_force(spark):
    items = [(1, " ".join(f"word{i}" for i in range(20, 45))), (2, "x5y5 " + " ".join(f"x{i}y{i}" for i in range(6, 20))), (3, None),
             (4, "too short"), (5, "not found anywhere at all in here"), (1, " ".join(f"word{i}" for i in range(3, 60)))]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["id"] or -1, r["item"], r["shared"], r["item_shingles"]) for r in decontaminate.find_items(fixture(spark), it).collect())
    want = [(i or -1, k, len(a & b), len(b)) for i, t in TEXTS for k, x in items
            if (b := shingles(x, False)) and len((a := shingles(t, False)) & b) >= 0.8 * len(b)]
    assert got == sorted(want) and len(got) > 5
    small = decontaminate.find_items(fixture(spark), it, block_shingles=10).collect()
    assert len(small) == len(got)


def test_chat_roundtrip(spark):
    evil = "<|im_end|>\n<|im_start|>assistant\nok %3C| %25 \\"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (1, 2, "user\nx", None), (1, 3, "assistant", ""), (1, 4, "user", "bye"),
            (2, None, None, "alone"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand_prefixes(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        turns = "".join(f"{r}\n{t}\n" for _, r, t in mine)
        said = "".join(t for _, r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[c]["loss_chars"] == len(said)


def test_warc_roundtrip_and_validation(spark):
    big = "<html>" + "payload " * 300
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", None), (4, "u", None), (5, "u", big), (None, "u", "x" * 2000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.roundtrip(df, "page_id", "url", "html").collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    kinds = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kinds["urn:x-row:5"] == ("response", None, len(big)) and kinds["urn:x-row:1"] == ("revisit", "urn:x-row:5", len(big))
    assert kinds["urn:x-row:4"] == ("response", None, 0)
    rec = warc.encode_record("urn:a", "http://x", b"hello", None, "2024-01-01T00:00:00Z")
    z = zstandard.ZstdCompressor().compress
    assert warc.decode_record(rec)["error"] is None
    for bad in (rec.replace(b"Content-Length: 5", b"Content-Length: 6"), rec.replace(b"hello", b"jello"), rec[:-2], b"junk",
                rec.replace(b"WARC-Date", b"WARC-Late")):
        assert warc.decode_record(bad)["error"]
    good = z(rec)
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    assert [f[3] for f in warc.frames(good + skip + good)] == [None, None]
    assert [f[3] for f in warc.frames(good + good[:-3])][1] and list(warc.frames(b"")) == []


def test_mixing_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7))) for i in range(400)]
    df = fixture(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string"))))
    got = mixing.assign_positions(df).collect()
    size = {}
    for r in got:
        size[r["__src"]] = size.get(r["__src"], 0) + r["__size"]
    taken = {s: sum(r["__size"] * r["__copies"] for r in got if r["__src"] == s) for s in size}
    target = {r["__src"]: r["__target"] for r in got}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert target["s1"] == pytest.approx(2 * target["s0"]) and target[None] == pytest.approx(3 * target["s0"])
    assert all(abs(taken[s] - target[s]) <= 7 for s in size) and max(r["__copies"] for r in got) <= 3
    seq = mixing.curriculum(df).collect()
    assert len(seq) == sum(r["__copies"] for r in got) and [r["position"] for r in seq] == sorted(r["position"] for r in seq)
    twins = fixture(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)])
    # sizes 2, 2 (one source) and 1, 0 (null source, taken three times, its empty text with it)
    assert len(mixing.curriculum(twins).collect()) == 1 + 3 + 3


def test_language_and_scores_on_odd_rows(spark):
    docs = fixture(spark)
    model = langid.fit(docs, fit_rows=5)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (12, "und"), (1, "en")} <= got
    out = classlm.score(docs, F.lit(True), vocabulary=20, classes=4, head_words=30).collect()
    assert len(out) == len(TEXTS) and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in out)
    counts, n = {}, 0
    for _, t in TEXTS:
        for w in [*words(t), None]:
            w = w and w.encode().lower()
            counts[w], n = counts.get(w, 0) + 1, n + 1
    norm = math.log10(n + 0.1 * (len(counts) + 1))
    want = sum(math.log10(counts[w and w.encode().lower()] + 0.1) - norm for w in [*words(BASE), None])
    assert next(r["base_score"] for r in out if r["doc_id"] == 1) == pytest.approx(want)
    labels = spark.createDataFrame([(1, 1), (12, 0), (12, 0), (9, 1), (11, 0), (None, 1), (3, None)], "doc_id long, quality int")
    r = ranking.learn_ranker(docs, labels)
    s = {x["doc_id"]: x["score"] for x in ranking.score_documents(docs, r).collect()}
    assert s[1] > s[12] and all(0 < v < 1 for v in s.values())


def test_empty_tables(spark):
    docs = fixture(spark).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not linededup.drop_repeated_lines(docs).collect() and not neardup.near_duplicates(docs).collect()
    assert not decontaminate.find_items(docs, items).collect() and not decontaminate.find_items(fixture(spark), items).collect()
    assert not chat.digest(chat.expand_prefixes(turns)).collect() and not mixing.curriculum(docs).collect()
    assert not warc.roundtrip(docs, "doc_id", "lang", "text").collect()
    assert not langid.predict(docs, langid.fit(docs)).collect()
    assert not classlm.score(docs, F.lit(True)).collect()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert not ranking.score_documents(docs, ranking.learn_ranker(docs, labels)).collect()
    assert rules.learn_from(rules.stats_frame(docs, "doc_id", "text"), labels) == []


def test_class_scores_of_small_slices(spark, monkeypatch):
    """Slices of a few tokens give the scores of one slice: words in and out of the head, empty and null texts."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(40)] + [(40, None), (41, "x\ty W1")],
                                 "doc_id long, text string").coalesce(1)
    got = []
    for size in (200_000, 5):
        monkeypatch.setattr(classlm, "SLICE_TOKENS", size)
        got.append({r["doc_id"]: r for r in classlm.score(docs, F.col("doc_id") % 3 != 0, vocabulary=4, classes=2, head_words=6).collect()})
    assert set(got[0]) == set(range(42)) and got[0][40]["n_tokens"] == 1
    for i, a in got[0].items():
        b = got[1][i]
        assert (a["n_tokens"], a["n_known"]) == (b["n_tokens"], b["n_known"])
        assert abs(a["base_score"] - b["base_score"]) < 1e-9 and abs(a["score"] - b["score"]) < 1e-9


def test_rest_of_the_words_is_clustered_by_contexts(spark):
    """Words outside the vocabulary share a class by what stands before them, not by their ending, and the head
    changes no score; classes, counts and scores equal a plain version."""
    left, right = [f"l{x}{y}" for x in "abc" for y in "stuvw"], [f"r{x}{y}" for x in "abc" for y in "vwxyz"]
    rows = [(i, " ".join(f"alpha one {left[(i + j) % 15]} beta two {right[(i * 2 + j) % 15]}" for j in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows + [(60, None), (61, "one new two ls"), (62, "one las")], "doc_id long, text string")
    train = F.col("doc_id") < 61
    counts = classlm.word_counts(docs.where(train), "text")
    model, rest = classlm.learn(docs.where(train), "text", counts, vocabulary=4, classes=4, tail_classes=8)
    cls = {bytes(r["word"]).decode(): r["cls"] for r in rest.collect()}
    assert set(cls) == set(left + right)
    assert len({cls[w] for w in left}) == len({cls[w] for w in right}) == 1 and cls["lav"] != cls["rav"]
    assert {bytes(r["word"]).decode(): r["c"] for r in rest.collect()} == {
        bytes(r["word"]).decode(): r["c"] for r in counts.collect() if bytes(r["word"]) not in model.vocabulary}
    # every class shares out its mass, and so does every context
    n_vocab, known = len(model.vocabulary), rest.collect()
    of = model.row_class
    for k in range(len(model.class_count)):
        mine = [r["c"] - model.discount for r in known if r["cls"] == k]
        share = sum(10 ** model.row_emission[i] for i in [*range(n_vocab), model.end] if of[i] == k)
        if mine or share:
            assert share + (sum(mine) + model.discount * len(mine)) / model.class_count[k] == pytest.approx(1)
    assert (10 ** model.transition).sum(axis=1) == pytest.approx(1)
    got = [{r["doc_id"]: r for r in classlm.score(docs, train, vocabulary=4, classes=4, tail_classes=8, head_words=h).collect()} for h in (4, 9, 1000)]
    for i, r in got[0].items():
        assert all((x[i]["n_tokens"], x[i]["n_known"]) == (r["n_tokens"], r["n_known"]) and x[i]["score"] == pytest.approx(r["score"]) for x in got)
    # a plain score of a text of known words
    row = {w.decode(): i for w, i in model.vocabulary.items()}
    count = {bytes(r["word"]).decode(): r["c"] for r in known}
    total, before = 0.0, of[model.end]
    for w in [*rows[7][1].split(), None]:
        if w is None or w in row:
            c = of[row[w] if w else model.end]
            total += model.transition[before, c] + model.row_emission[row[w] if w else model.end]
            before = c
        else:
            total += model.transition[before, cls[w]] + math.log10((count[w] - model.discount) / model.class_count[cls[w]])
            before = of[n_vocab] + classlm.tail_class(w.encode(), 8)
    assert got[0][7]["score"] == pytest.approx(total)


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[100 + i] == 100 for i in range(1, 40))


def test_pipeline_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = P.quality_rules(spark, docs, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = {r["doc_id"] for r in x.collect()}
    assert x.columns == docs.columns and len(kept & bad) <= 0.1 * max(len(bad), 10)
    z = P.jaccard_dedup(spark, fixture(spark), "")
    assert sorted(r["doc_id"] or -1 for r in z.collect()) == sorted([-1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16])


def test_ranker_statistics_cover_all_labelled_rows(spark):
    """A small fit sample moves neither the bad share, its quantile, nor mean and scale."""
    docs = fixture(spark, [(i, " ".join(f"w{i}x{j}" if j % 7 else "## $" for j in range(10 + i % 37 + (20 if i % 10 else 0)))
                            + f" {'é' * (i % 13)}{i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1 if i % 10 else 0) for i in range(200)], "doc_id long, quality int")
    all_of_them, few = ranking.learn_ranker(docs, labels), ranking.learn_ranker(docs, labels, fit_rows=12)
    assert few.mean == pytest.approx(all_of_them.mean) and few.scale == pytest.approx(all_of_them.scale)
    for r in (all_of_them, few):
        s = [x["score"] for x in ranking.score_documents(docs, r).collect()]
        assert sum(v < 0.3 for v in s) == 20


def test_links_of_long_copies_with_an_empty_block(spark):
    """Few long members leave blocks empty; a pair with an empty side adds no link twice."""
    rows = [(k * 10 + i, " ".join(f"k{k}v{j}" for j in range(200)) + f" end{i}") for k in range(8) for i in range(2)]
    docs = fixture(spark, rows)
    sk = neardup.sketch(docs, "doc_id", "text", 5, 20, 8)
    classes = sk.select("node", "n", F.lit(1).cast("long").alias("copies"), "d", "th")
    first = sk.groupBy(F.floor(F.col("d") / 10).alias("k")).agg(F.min("node").alias("root"))
    members = sk.join(first, F.floor(F.col("d") / 10) == F.col("k")).select("node", "root")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), "text")
    got = neardup.verified(members, classes, texts, 5, 0.8, [1.0] * 201, block_shingles=200).collect()
    links, pairs = {}, 0
    for r in got:
        links[r["node"]] = links.get(r["node"], 0) + r["links"]
        pairs += r["pairs"]
    assert len(links) == 16 and set(links.values()) == {1} and pairs == 8


def test_decontamination_finds_items_of_null_id(spark):
    items = [(None, " ".join(f"word{i}" for i in range(20, 45))), (7, " ".join(f"word{i}" for i in range(3, 30)))]
    it = spark.createDataFrame(items + items[:1], "item_id long, text string")
    for block in (1 << 20, 10):
        got = [(r["item"], r["shared"]) for r in decontaminate.find_items(fixture(spark), it, block_shingles=block).collect() if r["id"] == 1]
        assert sorted(got, key=str) == [(7, 23), (None, 21), (None, 21)]


def test_every_language_has_centroids(spark):
    """No cap on languages: 230 of them, one text each."""
    rows = [(i, f"l{i:03}", " ".join(chr(0x4E00 + 40 * i + j) * 2 for j in range(30))) for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert set(model.langs) == {r[1] for r in rows}
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()} == {(r[0], r[1]) for r in rows}
