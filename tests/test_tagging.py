"""Phrase tags against a plain scan, overlapping terms included."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakesmith.operators import tagging as TG


def plain(text, terms):
    toks = re.findall(r"[^\W_]+", (text or "").lower())
    i, out = 0, []
    while i < len(toks):
        for n in (3, 2, 1):
            t = " ".join(toks[i: i + n])
            if len(toks[i: i + n]) == n and t in terms:
                out.append(t)
                i += n
                break
        else:
            i += 1
    return out


def run(spark, names, texts):
    d = TG.phrase_dictionary(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["term"] for r in d.collect()}, {r["doc_id"]: r for r in TG.phrase_tags(docs, "doc_id", "text", d).collect()}


def test_names_are_cored_and_overlaps_resolved(spark):
    names = ["Lá  lốt", "cỏ xước (ngưu tất)", "b c", "a b", "c d e", "a", "c", None, "", "one two three four", "B  C", "(x y)"]
    texts = ["a b c d e", "c d e a b", "Ngưu Tất, lốt; cỏ-xước!", None, "", "nothing here", "one two three four", "a a b b c c d", "x y x"]
    terms, got = run(spark, names, texts)
    assert terms == {"lốt", "cỏ xước", "ngưu tất", "b c", "a b", "c d e", "a", "c", "x y"}
    for i, t in enumerate(texts):
        want = plain(t, terms)
        assert got[i]["n_matches"] == len(want) and got[i]["tag_list"] == sorted(set(want))
        assert got[i]["tags"] == (",".join(sorted(set(want))) or "không xác định")
    assert got[0]["tag_list"] == ["a b", "c d e"] and got[2]["tag_list"] == ["cỏ xước", "lốt", "ngưu tất"]


def test_empty_dictionary_and_table(spark):
    _, got = run(spark, [], ["a b"])
    assert got[0]["tag_list"] == [] and got[0]["n_matches"] == 0
    _, got = run(spark, ["a"], [])
    assert got == {}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(names=st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(" ".join), max_size=8),
       texts=st.lists(st.lists(st.sampled_from("abcde"), max_size=40).map(" ".join), min_size=1, max_size=12))
def test_any_dictionary(spark, names, texts):
    terms, got = run(spark, names, texts)
    assert terms == {n for n in names if len(n.split()) <= 3}
    assert all(got[i]["n_matches"] == len(plain(t, terms)) and got[i]["tag_list"] == sorted(set(plain(t, terms))) for i, t in enumerate(texts))
