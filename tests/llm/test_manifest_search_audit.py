"""Merkle manifest, bit-sliced search and filter audit against plain-Python versions, on rows with nulls,
blank and long texts, ties, repeats, clashing columns and on empty tables."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesmith.llm import bitslice, interaction, merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, pos string, mask int, id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "clash", 1, "x", 7, "y") for i, t, lang, s, n in rows], SCHEMA)


def sample(n=70):
    rows = [(i, f"text {i}\nline é {'w ' * (i % 9)}", "en" if i % 3 else None, ["a", "b", "é", None][i % 4 if i < 60 else 0], i)
            for i in range(n)]
    rows += [(None, "no id\n", "en", "a", 1), (None, None, None, None, None), (3, "text again", "en", "b", 2), (3, "text again", "en", "b", 2),
             (900, "", "en", "", 0), (901, "x\n" * 60000, "en", "lonely", 5), (902, None, "en", "-", None)]
    return rows


# --- Merkle ----------------------------------------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i: i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i - i % 3
        out.append((nodes[first:i], nodes[i + 1: first + 3]))
        i //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for i, t, lang, s, n in rows:
        groups.setdefault(s, []).append((i, s, lang, n, t))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    if not rows:
        return []
    top = levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for place, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, place)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", ""))) if changed else leaf(r)
            for left, right in path:
                now = digest(*left, now, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], root, digest(*[x for left, right in path for x in left + right]), now, now == root))
    return sorted(out, key=str)


def prove(docs, span_bits=9, depth=5, where=None):
    leaves = merkle.leaf_rows(docs, FIELDS, "doc_id", "source", altered={"text": F.replace("text", F.lit("\n"), F.lit(""))},
                              where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    m = merkle.manifest(leaves, span_bits, depth)
    return m, merkle.prove(m, where)


@pytest.mark.parametrize("span_bits, depth", [(9, 5), (3, 1), (2, 2)])
def test_manifest_matches_plain_version(spark, span_bits, depth):
    rows = sample()
    got = prove(documents(spark, rows), span_bits, depth)[1].collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_manifest(rows)


def test_single_leaves_and_empty_manifest(spark):
    for rows in ([(1, "a\nb", "en", "s", 1)], [(1, "a", "en", None, 1), (2, "b", "en", "s", 1)], []):
        got = prove(documents(spark, rows))[1].collect()
        assert sorted([tuple(r) for r in got], key=str) == plain_manifest(rows)


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"t{i}", "en", "s" if i % 5 else "r", 1) for i in range(200)]
    want = {r[0]: r for r in plain_manifest(rows)}
    got = prove(documents(spark, rows), span_bits=4, where=F.col("id") % 7 == 0)[1].collect()
    assert sorted(r["id"] for r in got) == list(range(0, 200, 7)) and all(tuple(r) == want[r["id"]] for r in got)


def test_missing_coordinates_are_minimal_and_fetched_once(spark):
    """What is fetched plus the leaves yields the root; without any one of the coordinates it does not."""
    for n, known in ((1, [0]), (2, [1]), (30, [0, 1, 2, 5]), (100, [99]), (82, list(range(10, 50))), (9, list(range(9)))):
        need = merkle.missing(np.array(known), n)
        assert len(need) == len(set(need)) and all(not (k == 0 and i in known) for k, i in need)

        def derivable(have):
            size, level, have = n, 0, set(have)
            while size > 1:
                have |= {(level + 1, p) for p in range(-(-size // 3)) if all((level, c) in have for c in range(3 * p, min(3 * p + 3, size)))}
                size, level = -(-size // 3), level + 1
            return (level, 0) in have
        have = {(0, i) for i in known} | set(need)
        assert derivable(have) and not any(derivable(have - {x}) for x in need)
    m, _ = prove(documents(spark, [(i, f"t{i}", "en", "s", 1) for i in range(100)]), span_bits=4)
    _, coordinates = merkle.missing_nodes(m, m.leaves)
    assert coordinates.count() == coordinates.distinct().count() < 100 * 4


# --- bit-sliced search -----------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, place string, block int")


def plain_search(rows, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(usable) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def search(df, **options):
    rows = bitslice.quantise(df, "vec_id", "embedding", 1024)
    return sorted(tuple(r) for r in bitslice.top_k(rows, F.col("id") % 100 == 0, **options).collect())


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(0, 900, 3)]
    rows += [(-100, [0.5] * 6), (1, [0.25] * 6), (1, [0.25] * 6), (2, [0.25] * 6), (300, [0.0] * 6), (600, [1.0, 2.0]), (7, []),
             (None, [1.0] * 6), (5, None), (8, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10, [float("nan")] * 6), (11, [float("inf")] * 6),
             (12, [1000.0, -1000.0, 0.0, 1e-9, -1e-9, 3.0])]
    df, want = vectors(spark, rows), plain_search(rows, 10)
    assert search(df) == want
    assert search(df, block_bits=6, group_bits=7, most_questions=2) == want  # many blocks, groups and question blocks
    assert search(df, k=500) == plain_search(rows, 500)


def test_search_ties_across_blocks_and_small_tables(spark):
    rows = [(i, [0.5, -0.25]) for i in range(400)]
    assert search(vectors(spark, rows), block_bits=6) == plain_search(rows, 10)
    assert search(vectors(spark, [(0, [1.0]), (1, [2.0])])) == [(0, 1, 1, 1024 * 2048)]
    assert search(vectors(spark, [(0, []), (3, []), (2, [])])) == [(0, 1, 2, 0), (0, 2, 3, 0)]
    assert search(vectors(spark, [(0, [1.0])])) == [] and search(vectors(spark, [])) == [] and search(vectors(spark, [(1, [1.0])])) == []


def test_slices_add_up_to_the_scores():
    rng = np.random.default_rng(1)
    for span in (1, 7, 5000):
        values = rng.integers(-span, span + 1, size=(130, 5))
        low, slices = bitslice.slice_block(values)
        for question in (rng.integers(-span, span + 1, size=5), np.zeros(5, dtype=np.int64), np.array([span, 0, -1, 0, 1])):
            sums = bitslice.score_slices(bitslice.schedule(question, slices.shape[1]), bitslice.planes(slices))
            extra = bitslice.offset(question, low, slices.shape[1], bitslice.negatives(question))
            assert (bitslice.scores_of(np.arange(130), sums, extra) == values @ question).all()
    for v in (0, 1, -1, 3, -7, 1023, -777):
        digits = bitslice.signed_digits(np.array([v]))
        assert sum((-1 if minus else 1) << place for _, place, minus in digits) == v
        assert all(b - a > 1 for a, b in zip(digits[:, 1], digits[1:, 1]))


# --- filter audit ----------------------------------------------------------------------------------

def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    texts = [(i, t or "", s or "") for i, t, _, s, _ in rows]
    fails = []
    for i, t, _ in texts:
        w = words(t)
        fails.append({f for f, failed in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)),
                                          ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                                          ("E", i is not None and any(j is not None and j < i and t == u for j, u, _ in texts))) if failed})
    out = []
    for part in {s for _, _, s in texts}:
        mine = [(i, fails[k]) for k, (i, _, s) in enumerate(texts) if s == part]
        rows_of, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                shapley[f] += len(gone)
                rows_of.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in m for _, m in mine) - len(gone),
                                sum(m == {f} for _, m in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows_of]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = sample() + [(1000 + i, t, "en", ["a", None, ""][i % 3], 1) for i, t in enumerate(
        [long, long, long + " #", long.upper(), "a " * 70, "A " * 70 + "$", None, "", " \t", long + " #", long.replace("w1", "W1"), "é" * 500])]
    rows += [(1000, long, "en", "a", 1), (None, long, "en", "a", 1), (1001, "other # text", "en", "zz", 1)]
    labels = [(1000, 1, 0), (1000, 1, 1), (1001, 1, 0), (1002, 0, 1), (1003, None, 1), (None, 1, 1), (3, 1, None), (5555, 1, 1)]
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = interaction.audit(interaction.masks(documents(spark, rows), marks)).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(interaction.masks(documents(spark, []), marks)).collect() == []
    got = interaction.audit(interaction.masks(documents(spark, [(1, None, None, None, None)]), marks)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120


def test_intervals_are_the_orders_of_each_removal():
    orders = sorted("".join(p) for p in permutations("ABCDE"))
    assert [interaction.lehmer_rank(o, "ABCDE") for o in orders] == list(range(120))
    cover = {}
    for mask, step, f, start, end in interaction.intervals():
        for r in range(start, end):
            assert (mask, r) not in cover
            cover[mask, r] = (step, f)
    for mask in range(1, 32):
        for r, o in enumerate(orders):
            at = next(i for i, f in enumerate(o) if mask >> "ABCDE".index(f) & 1)
            assert cover[mask, r] == (at + 1, o[at])
