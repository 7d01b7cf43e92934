"""The base columns of two queries whose verdict or score has no SQL form, against SQL."""

import zlib

import pytest

from lakesmith.llm import queries as Q
from oracle_compare import duck

DIR = "/root/testdata/sf0.001"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN rep USING (doc_id, s), range(5) r(k) GROUP BY doc_id)
SELECT doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')),
       coalesce(dup.n, 0), coalesce(cov.n, 0), len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w)
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)"""

SCORES = rf"""
WITH f AS (SELECT unnest(?) AS doc_id, unnest(?) AS fold),
d AS (SELECT doc_id, fold, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), '') AS w FROM documents JOIN f USING (doc_id)),
c AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM d WHERE fold <> 0) GROUP BY x),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(fold) = 0, count(*), count(c.c), any_value(n.n),
       sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1))))
FROM (SELECT doc_id, fold, unnest(w) AS x FROM d) t LEFT JOIN c USING (x), n GROUP BY doc_id"""


def test_rule_statistics(spark):
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                 for r in Q.op2_quality_rules(spark, DIR).collect())
    assert got == sorted(tuple(r) for r in duck(DIR).sql(RULES).fetchall())


def test_unigram_scores(spark):
    con = duck(DIR)
    ids = [r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()]
    want = {r[0]: r[1:] for r in con.execute(SCORES, [ids, [zlib.crc32(str(i).encode()) % 10 for i in ids]]).fetchall()}
    got = Q.op6_class_ngram_scores(spark, DIR).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        held, tokens, known, train, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, train)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
