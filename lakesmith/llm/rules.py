"""Learned decision lists for text quality (native).

Statistics of every whole text are plain column expressions.  From labelled statistics, sequential
covering learns an ordered list of threshold conjunctions that mark bad texts: each rule is grown
condition by condition (information gain on the growing part), pruned back on the pruning part, and
the rows that it covers are set aside before the next.  The list is emitted as one ordered
``CASE WHEN``.

Learning reads the whole labelled table: every growth step is one map-side-combined histogram
``(feature, bin) -> counts``, whose size is bounded by features x bins, and only that reaches the
driver.

Defined results: null and blank texts have no words, zero counts and null ratios (no rule matches a
null); repeated rows are judged alike; without labels of both kinds the list is empty and every text
that passes the base is kept; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import BLANKS, bind, materialise, words

SYMBOLS = "#*$%&|<>"

#: Names of the learnable ratios of :func:`with_stats`.
FEATURES = ("words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "letter_ratio",
            "upper_ratio", "distinct_ratio", "line_words")


# --- statistics ----------------------------------------------------------------------------------

def _covered(hashes: Column, k: int) -> Column:
    """Words that lie in a window whose hash occurs twice or more: sort (hash, position), keep those
    equal to a neighbour, and add up the union of their windows."""
    s = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def union(ss: Column) -> Column:
        same = lambda e, j: (F.coalesce(e["h"] == F.get(ss, j - 1)["h"], F.lit(False))
                             | F.coalesce(e["h"] == F.get(ss, j + 1)["h"], F.lit(False)))
        at = F.sort_array(F.transform(F.filter(ss, same), lambda e: e["i"]))
        return bind(at, lambda ps: F.aggregate(
            F.transform(ps, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(ps, j + 1) - p, F.lit(k)))),
            F.lit(0), lambda a, x: a + x))
    return bind(s, union)


def window_hashes(w: Column, k: int = 5) -> Column:
    """Hashes of the ``k``-word windows of array ``w``."""
    return bind(F.transform(w, lambda x: F.xxhash64(x)), lambda q: F.transform(
        F.slice(q, F.lit(1), F.greatest(F.size(q) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[q[i + j] for j in range(1, k)])))


def repeat_words(h: Column, k: int = 5) -> Column:
    """Number of words in windows found twice or more, from the window hashes of a text."""
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, k))


def with_stats(rows: DataFrame, text: str, out: str = "__stats") -> DataFrame:
    """Append a struct of counts (long) of the whole text in column ``text``, which is dropped.

    The arrays are columns of their own, used more than once, so that each is computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    others = [c for c in rows.columns if c != text]
    x = rows.select(
        *others, words(F.col(text)).alias("__w"),
        F.filter(F.split(t, "\n"), lambda v: F.btrim(v, F.lit(BLANKS)) != "").alias("__ls"),
        F.struct((F.length(t) - kept(r"[#*$%&|<>]+")).alias("n_symbols"), kept(r"[^\p{L}]+").alias("n_letters"),
                 (F.length(t) - kept(r"\p{Lu}+")).alias("n_upper")).alias("__c"))
    n = lambda c: F.size(c).cast("long")
    x = x.select(
        *others, "__c", window_hashes(F.col("__w")).alias("__h"),
        F.struct(n("__ls").alias("n_lines"), (n("__ls") - n(F.array_distinct("__ls"))).alias("n_dup_lines")).alias("__l"),
        n("__w").alias("__n"), F.length(F.array_join("__w", "")).cast("long").alias("__chars"),
        n(F.array_distinct("__w")).alias("__distinct"))
    w = F.struct(F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"),
                 repeat_words(F.col("__h")).cast("long").alias("n_repeat_words"), F.col("__distinct").alias("n_distinct"))
    return x.select(*others, F.struct(w.alias("w"), F.col("__l").alias("l"), F.col("__c").alias("c")).alias(out))


def ratio_columns(s: Column) -> list[Column]:
    """The learnable ratios of a :func:`with_stats` struct, in the order of ``FEATURES``."""
    n, chars = F.nullif(s["w"]["n_words"], F.lit(0)), F.nullif(s["w"]["word_chars"], F.lit(0))
    lines, letters = F.nullif(s["l"]["n_lines"], F.lit(0)), F.nullif(s["c"]["n_letters"], F.lit(0))
    made = (n, chars / n, s["c"]["n_symbols"] / chars, s["l"]["n_dup_lines"] / lines, s["w"]["n_repeat_words"] / n,
            s["c"]["n_letters"] / chars, s["c"]["n_upper"] / letters, s["w"]["n_distinct"] / n, n / lines)
    return [c.cast("double").alias(name) for c, name in zip(made, FEATURES)]


def base_failed(s: Column) -> Column:
    return (s["w"]["n_words"] < 10) | (100 * s["w"]["n_repeat_words"] > 20 * s["w"]["n_words"])


# --- learning ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"`{self.feature}`")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _conjunction(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & F.coalesce(c.column(), F.lit(False))
    return out


def _none_of(rules: Sequence[Rule]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & ~_conjunction(r)
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """The ordered conditional expression: the first rule that matches rejects; else keep."""
    out = None
    for r in rules:
        out = F.when(_conjunction(r), F.lit(False)) if out is None else out.when(_conjunction(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _foil(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _with_middles(values: list[float]) -> list[float]:
    """The values and the middles between neighbours, so that a cut may lie in the gap of two classes."""
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def learn_rules(labelled: DataFrame, label_col: str, key_col: str, features: Sequence[str] = FEATURES,
                quantiles: int = 32, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.8,
                min_cover: float = 0.002) -> list[Rule]:
    """Sequential covering over ``labelled`` (features, ``label_col`` 1 good / 0 bad, ``key_col``).

    Two thirds of the rows (by hash of the key) grow rules, one third prunes them.  A rule is
    accepted while, on the pruning part, its precision is at least ``min_precision`` and it covers
    ``min_cover`` of the bad rows; learning ends with the first rule that is not."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        (F.col(label_col) == 0).cast("int").alias("__bad"),
        (F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(3)) != 0).alias("__grow"), *features)
    rows = materialise(rows, "labelled-stats")
    share = [i / (quantiles + 1) for i in range(quantiles + 2)]  # least and largest value included
    cuts = rows.groupBy("__bad").agg(*[F.percentile_approx(f, share, 10000).alias(f) for f in features]).collect()
    if len(cuts) < 2:
        return []
    thresholds = {f: _with_middles(sorted({float(v) for r in cuts for v in (r[f] or [])})) for f in features}
    features = [f for f in features if thresholds[f]]

    def bin_of(f: str) -> Column:
        below = F.filter(F.array(*[F.lit(t) for t in thresholds[f]]), lambda t: t < F.col(f))
        return F.when(F.col(f).isNotNull(), F.size(below)).otherwise(F.lit(-1))
    bins = [bin_of(f) for f in features]
    rows = materialise(rows.select("*", F.array(*bins).alias("__bins")), "binned-stats")

    def histogram(where: Column) -> tuple[float, float, dict]:
        got = (rows.where(F.col("__grow") & where).select("__bad", F.posexplode("__bins").alias("f", "b"))
               .groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("__bad").alias("bad")).collect())
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in got:
            table.setdefault(r["f"], {})[r["b"]] = (r["bad"], r["n"] - r["bad"])
        first = next(iter(table.values()), {})
        return sum(v[0] for v in first.values()), sum(v[1] for v in first.values()), table

    def grow(left: Column) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            p0, n0, table = histogram(left & _conjunction(rule))
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for fi, name in enumerate(features):
                counts, p, n = table.get(fi, {}), 0, 0
                known_p = sum(v[0] for b, v in counts.items() if b >= 0)
                known_n = sum(v[1] for b, v in counts.items() if b >= 0)
                worth: dict[bool, list[tuple[float, float]]] = {False: [], True: []}
                for j, t in enumerate(thresholds[name]):
                    p, n = p + counts.get(j, (0, 0))[0], n + counts.get(j, (0, 0))[1]
                    worth[False].append((_foil(p, n, p0, n0), t))
                    worth[True].append((_foil(known_p - p, known_n - n, p0, n0), t))
                for above, tried in worth.items():
                    top = max(g for g, _ in tried)
                    if top > gain:  # of equally good cuts the middle one: the widest margin
                        tied = [t for g, t in tried if g >= top - 1e-9]
                        best, gain = Condition(name, above, tied[len(tied) // 2]), top
            if best is None:
                break
            rule.append(best)
        return rule

    def prune(left: Column, rule: list[Condition]) -> tuple[Rule, float, float]:
        """The prefix of the rule with the best (p - n) / (p + n) on the pruning part."""
        sums = []
        for k in range(1, len(rule) + 1):
            hit = _conjunction(rule[:k])
            sums += [F.sum(F.when(hit, F.col("__bad"))).alias(f"p{k}"), F.sum(F.when(hit, 1 - F.col("__bad"))).alias(f"n{k}")]
        r = rows.where(~F.col("__grow") & left).agg(F.sum("__bad").alias("all"), *sums).first()
        best, worth = 0, -2.0
        for k in range(1, len(rule) + 1):
            p, n = r[f"p{k}"] or 0, r[f"n{k}"] or 0
            if p + n and (p - n) / (p + n) > worth + 1e-12:
                best, worth = k, (p - n) / (p + n)
        if not best:
            return (), 0.0, 0.0
        return tuple(rule[:best]), (worth + 1) / 2, r[f"p{best}"] or 0

    all_bad = rows.where(~F.col("__grow")).agg(F.sum("__bad")).first()[0] or 0
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = _none_of(rules)
        grown = grow(left)
        if not grown:
            break
        rule, precision, covered = prune(left, grown)
        if not rule or precision < min_precision or covered < max(1.0, min_cover * all_bad):
            break
        rules.append(rule)
    return rules


# --- use -----------------------------------------------------------------------------------------

def stats_frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, __stats, ratios...)`` per document, written once (narrow: no text)."""
    s = with_stats(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    return materialise(s, "text-stats").select("__id", "__stats", *ratio_columns(F.col("__stats")))


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **kw) -> list[Rule]:
    """Rules from :func:`stats_frame` rows and a label table; of several labels of one id the
    lowest holds.  Rows that fail the base are no examples: they are rejected anyway."""
    one = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
           .agg(F.min(label_col).alias("__label")))
    return learn_rules(stats.where(~base_failed(F.col("__stats"))).join(one, "__id"), "__label", "__id", **kw)


def keep_good(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass the base and the decision list, with their own columns."""
    x = with_stats(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                               F.col(text_col).alias("__text")), "__text")
    x = x.select("__row", "__stats", *ratio_columns(F.col("__stats")))
    return x.where(~base_failed(F.col("__stats")) & verdict(rules)).select("__row.*")
