"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its text statistics.  Preference pairs (a good and a
bad labelled document) give the logistic loss ``log(1 + exp(-w . (x_good - x_bad)))`` on feature
differences.  The threshold is a quantile of the training scores (the share of bad ones), and scores
are squashed to (0, 1) so that the threshold falls on ``cut``.

Only the weights are fitted on a bounded, documented sample of labelled rows (``fit_rows`` of each
label, smallest key hash).  Means, scales, the bad share, its exact quantile and the spread are
aggregates over all labelled rows; scoring runs in column expressions.

Defined results: null and blank texts are scored by their (zero) statistics like any other; repeated
rows get equal scores; without labels of both kinds every score is 0.5; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import bit_filter, materialise, may_contain
from lakesmith.llm.rules import ratio_columns, with_stats
from lakesmith.operators.sequence import sequence_within

#: Smooth features of the ratios: logarithms of counts, and squares so that both too low and too
#: high values of a ratio can count against a text.
NAMES = ("words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "letter_ratio",
         "upper_ratio", "distinct_ratio", "line_words")


#: Scaled features beyond this many deviations count as this many, in the fit and in every score.
CLIP = 8.0


def with_features(rows: DataFrame, text: str, out: str = "__x") -> DataFrame:
    """Replace column ``text`` by an array of doubles; undefined ratios (empty texts) are 0."""
    x = with_stats(rows, text, "__stats")
    return x.select(*[c for c in rows.columns if c != text], F.array(*_terms(F.col("__stats"))).alias(out))


def _terms(stats: Column) -> list[Column]:
    raw = {n: F.coalesce(c, F.lit(0.0)) for n, c in zip(NAMES, ratio_columns(stats))}
    logs = [F.log1p(raw[n]) for n in ("words", "word_length", "line_words")]
    ratios = [raw[n] for n in NAMES if n not in ("words", "word_length", "line_words")]
    return [*logs, *ratios, *[x * x for x in logs], *[F.sqrt(F.greatest(x, F.lit(0.0))) for x in ratios]]


@dataclass(frozen=True)
class Ranker:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    spread: float
    cut: float

    def strength(self, features: Column) -> Column:
        """The linear score before threshold and spread."""
        own = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("msw", p)]) for p in zip(self.mean, self.scale, self.weights)])
        scaled = F.zip_with(features, own, lambda x, p: F.greatest(F.least((x - p["m"]) / p["s"], F.lit(CLIP)), F.lit(-CLIP)) * p["w"])
        return F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)

    def score(self, features: Column) -> Column:
        """Score in (0, 1); a document at the threshold scores exactly ``cut``."""
        if not self.weights:
            return F.lit(0.5)
        z = (self.strength(features) - self.threshold) / self.spread + float(np.log(self.cut / (1 - self.cut)))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def preference_pairs(label: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``rounds`` pairings: every row of the larger class meets a row of the other, each time
    another (a cyclic shift), so the number of pairs is rounds x rows, never good x bad.  The step
    through the bad rows has no divisor in common with their number, so every row is in a pair."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    n, step = max(len(good), len(bad)), next(k for k in range(7, 7 + 2 * len(bad)) if math.gcd(k, len(bad)) == 1)
    g, b = [], []
    for r in range(rounds):
        i = np.arange(n)
        g.append(good[(i + r) % len(good)])
        b.append(bad[(i * step + r * 13 + i // len(bad)) % len(bad)])
    return np.concatenate(g), np.concatenate(b)


def fit_weights(x: np.ndarray, label: np.ndarray, mean: np.ndarray, scale: np.ndarray, rounds: int = 4,
                steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Full-batch gradient steps with momentum on the pairwise logistic loss."""
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    g, b = preference_pairs(label, rounds)
    diff = z[g] - z[b]
    w = np.zeros(x.shape[1])
    speed = np.zeros_like(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(axis=0) + ridge * w
        speed = 0.9 * speed - rate * 0.1 * grad
        w = w + speed
    return w


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                      usable: Column | None) -> DataFrame:
    """``(__id, __label, x)`` of all usable labelled documents (of several labels of one id the lowest
    holds).  A bitmap over the ids leaves out other texts before their statistics are taken; what is
    shuffled are features, not texts."""
    one = labels.where(F.col(label_col).isin(0, 1))
    if usable is not None:
        one = one.where(usable)
    one = one.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label")).where("__id is not null")
    some = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__id is not null")
    some = may_contain(some, F.xxhash64("__id"), bit_filter(one.select(F.xxhash64("__id").alias("h")), "h"), "__may")
    x = with_features(some.where("__may").drop("__may"), "__text", "x")
    return materialise(x.join(one, "__id").select("__id", "__label", "x"), "labelled-features")


def exact_quantile(rows: DataFrame, value: str, share: float, n: int) -> float:
    """Linear-interpolation quantile of ``n`` values: the two ranked rows around it."""
    at = share * (n - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    ranked = sequence_within(rows.select(value, F.monotonically_increasing_id().alias("__tie")), [], [value, "__tie"], name="__r")
    got = {r["__r"] - 1: r[value] for r in ranked.where(F.col("__r").isin(lo + 1, hi + 1)).select("__r", value).collect()}
    return float(got[lo] + (got[hi] - got[lo]) * (at - lo))


def learn_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", usable: Column | None = None, fit_rows: int = 8000, cut: float = 0.3,
                 **kw) -> Ranker:
    """Weights from at most ``fit_rows`` labelled rows of each label; all else from every labelled row."""
    rows = labelled_features(docs, labels, id_col, text_col, label_col, usable)
    width = 2 * len(NAMES)  # logs and ratios, and a square or root of each
    x = [F.col("x")[i] for i in range(width)]
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__label") == 0).alias("bad"),
                 *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    if s["bad"] in (0, s["n"]):
        return Ranker((), (), (), 0.0, 1.0, cut)
    # nine digits: the last ones depend on the order in which tasks are summed
    mean = np.array([float(f"{s[f'm{i}']:.9g}") for i in range(width)])
    scale = np.array([max(float(f"{s[f's{i}']:.9g}"), 1e-9) for i in range(width)])
    got = [r for v in (0, 1) for r in rows.where(F.col("__label") == v).orderBy(F.xxhash64("__id"), "__id", "x")
           .limit(fit_rows).select("__label", "x").collect()]
    sample, label = np.array([r["x"] for r in got]), np.array([r["__label"] for r in got])
    order = np.lexsort(sample.T)
    w = fit_weights(sample[order], label[order], mean, scale, **kw)
    bare = Ranker(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), 0.0, 1.0, cut)
    raw = materialise(rows.select(bare.strength(F.col("x")).alias("raw")), "labelled-strengths")
    threshold = exact_quantile(raw, "raw", s["bad"] / s["n"], s["n"])
    spread = max(raw.agg(F.stddev_pop("raw")).first()[0], 1e-9) / 2
    return Ranker(bare.mean, bare.scale, bare.weights, threshold, float(spread), cut)


def score_documents(docs: DataFrame, ranker: Ranker, text_col: str = "text", out_col: str = "score",
                    keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    x = with_features(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")), "__text")
    return x.select(*[F.col(f"`{c}`") for c in keep], ranker.score(F.col("__x")).alias(out_col))
