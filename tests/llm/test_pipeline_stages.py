"""The corpus pipeline, stage by stage and as a whole, against plain versions on a small folder of tables with
copies, near copies, repeated lines, benchmark passages, junk, null ids and texts, and extra columns."""

import random
import re

import pytest

import corpus_pipeline as P
from lakesmith.llm import mixing, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch int"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def make_rows():
    rng = random.Random(4)
    line = lambda i, j: " ".join(f"w{i}x{j}y{rng.randrange(999)}" for _ in range(12))
    good = {i: "\n".join(line(i, j) for j in range(5)) for i in range(120)}
    rows = list(good.items())
    rows += [(200 + i, " ".join(rng.choice(["#", "$$", "%%", f"word{rng.randrange(50)}"]) for _ in range(60))) for i in range(60)]  # junk
    rows += [(300, good[3]), (301, good[3]), (302, good[4].replace(words(good[4])[7], "changed")), (None, good[5] + "\n" + line(900, 1))]
    boiler = "please read these terms of use with care before you go on today"
    rows += [(310 + i, line(310 + i, 0) + "\n" + boiler.replace("today", d) + "\n" + line(310 + i, 1)) for i, d in enumerate(["today", "today", "tomorrow"])]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(320, line(320, 0) + " " + item + " " + line(320, 1)), (321, " ".join(words(item)[:8]) + " " + line(321, 1))]
    rows += [(330, None), (331, ""), (332, "too short"), (120, good[119] + " tail")]
    out = [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or ""), 7) for i, t in rows]
    labels = [(i, 1) for i in range(0, 120, 2)] + [(200 + i, 0) for i in range(0, 60, 2)]
    return out, labels, [(1, item), (2, "w0"), (None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = make_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plain_lines(docs):
    """Lines that repeat an earlier one (up to one word where both have eight or more) go, in the order of id."""
    def near(a, b):
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    seen, out = [], []
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        kept, dropped = [], 0
        for x in (t or "").split("\n"):
            w = words(x)
            if w and any(w == s or near(w, s) for s in seen):
                dropped += 1
                seen.append(w)
                continue
            if w:
                seen.append(w)
            kept.append(x)
        if not dropped or any(words(x) for x in kept):
            out.append((i, t if t is None else "\n".join(kept)))
    return out


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_near(docs):
    """Of each component of Jaccard 0.8 the row of smallest id stays (null first); equal ids with equal texts once."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k, d in enumerate(docs):
        if sets[k]:
            best.setdefault(find(k), []).append(d)
    return [min(v, key=lambda r: (r[0] is not None, r[0] or 0)) for v in best.values()] + [d for d, s in zip(docs, sets) if not s]


def plain_clean(docs, items):
    return [(i, t) for i, t in docs if not any(len(words(x)) >= 5 and len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x)) for x in items if x)]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_match_plain_versions(spark, folder):
    docs = P.read(spark, folder, "documents")
    kept = P.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns
    learnt = rules.learn_from(rules.stats_frame(docs, "doc_id", "text"), P.read(spark, folder, "labels"))
    assert learnt and pairs(kept) == pairs(rules.keep_good(docs, learnt))
    ids = {i for i, _ in pairs(kept)}
    assert not ids & set(range(200, 260)) and {330, 331, 332}.isdisjoint(ids) and set(range(120)) <= ids

    rows = pairs(docs)
    lines = P.line_dedup(spark, docs, folder)
    assert lines.columns == docs.columns and pairs(lines) == sorted(plain_lines(rows), key=str)
    near = P.jaccard_dedup(spark, docs, folder)
    assert near.columns == docs.columns and pairs(near) == sorted(plain_near(rows), key=str)
    clean = P.decontaminate_benchmark(spark, docs, folder)
    want = plain_clean(rows, [x for _, x in make_rows()[2]])
    assert clean.columns == docs.columns and pairs(clean) == sorted(want, key=str)
    assert 320 not in {i for i, _ in want} and 321 in {i for i, _ in want}
    mixed = P.mix_sources(spark, docs, folder).collect()
    plan = mixing.assign_positions(docs).collect()
    assert len(mixed) == sum(r["__copies"] for r in plan) and [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = P.read(spark, folder, "documents")
    learnt = rules.learn_from(rules.stats_frame(docs, "doc_id", "text"), P.read(spark, folder, "labels"))
    left = pairs(rules.keep_good(docs, learnt))
    for step in (plain_lines, plain_near):
        left = step(left)
    left = plain_clean(left, [x for _, x in make_rows()[2]])
    got = P.run(spark, folder).collect()
    assert {(r["doc_id"], r["text"]) for r in got} <= set(left)
    source = {(r["doc_id"], r["text"]): r["source"] for r in got}
    for s in {v for v in source.values()}:
        size = sum(len(words(t)) for i, t in left if ["a", "b", None][(i or 0) % 3] == s)
        taken = sum(len(words(r["text"])) for r in got if r["source"] == s)
        share = {"a": 1, "b": 2, None: 3}[s] * sum(len(words(t)) for _, t in left) / 6
        assert abs(taken - min(share, 3 * size)) <= 80


def test_stages_on_empty_tables(spark, folder):
    none = P.read(spark, folder, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).collect() == []
