"""Phrase tags (J11, P23): 1- to 3-gram dictionary terms, the longest ones that do not overlap.

Terms and texts are token lists.  The hash of an n-gram is rolled from that of its first n - 1 tokens and the
hash of its last one, so no n-gram is ever spelled out for the look-up; it meets the dictionary in an equi-join
on (n, hash), and the text of a hit is compared before it counts.  Of a text's hits the leftmost is taken, of
several at one position the longest, and the search goes on behind it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lakesmith.functions import text as T
from lakesmith.operators.parallel import spread
from lakesmith.operators.retrieval import UNKNOWN_TAG, bounded, tokens

MAX_TOKENS = 3


def _rolled(df: DataFrame, toks: str, max_n: int) -> DataFrame:
    """Append ``__h1 … __hn``: the hashes of the n-grams that start at each token."""
    df = df.withColumn("__h1", F.transform(toks, lambda t: F.xxhash64(t)))
    for n in range(2, max_n + 1):
        here = F.slice(f"__h{n - 1}", F.lit(1), F.greatest(F.size(f"__h{n - 1}") - 1, F.lit(0)))
        last = F.slice("__h1", F.lit(n), F.greatest(F.size("__h1") - (n - 1), F.lit(0)))
        df = df.withColumn(f"__h{n}", F.zip_with(here, last, lambda a, b: F.xxhash64(a, b)))
    return df


def phrase_dictionary(names: DataFrame, name_col: str, max_n: int = MAX_TOKENS) -> DataFrame:
    """``(term, n, hash)``: the core names (P23) of 1 to ``max_n`` tokens.  Longer and blank names have no row;
    spelling variants of one term (case, spaces, punctuation) are one."""
    core = names.select(F.explode(T.herb_core_names(name_col)).alias("name")).select(tokens("name").alias("t")).where(F.size("t").between(1, max_n))
    core = _rolled(core.distinct(), "t", max_n)
    n = F.size("t")
    hashed = F.coalesce(*[F.when(n == i, F.element_at(f"__h{i}", 1)) for i in range(1, max_n + 1)])
    return core.select(F.array_join("t", " ").alias("term"), n.alias("n"), hashed.alias("hash"))


@F.pandas_udf(ArrayType(BooleanType()))
def _leftmost_longest(positions: pd.Series, lengths: pd.Series) -> pd.Series:
    """Which of a text's hits, ordered by position and falling length, are taken."""
    def choose(at, n):
        end, out = 0, []
        for p, k in zip(at, n):
            out.append(bool(p >= end))
            end = p + k if p >= end else end
        return out
    return pd.Series([choose(p, n) for p, n in zip(positions, lengths)])


def phrase_hits(docs: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, max_n: int = MAX_TOKENS) -> DataFrame:
    """``(id, pos, n, term)``: every dictionary term at every token position (0-based), overlaps included."""
    toks = spread(docs, id_col).select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("__t"))
    rows = _rolled(toks, "__t", max_n)
    of = lambda n: F.transform(f"__h{n}", lambda h, i: F.struct(i.alias("pos"), F.lit(n).alias("n"), h.alias("hash")))
    grams = F.concat(*[of(n) for n in range(1, max_n + 1)])
    met = rows.select(id_col, F.inline(grams)).join(bounded(dictionary), ["n", "hash"])
    per_doc = met.groupBy(id_col).agg(F.collect_list(F.struct("pos", "n", "term")).alias("__hits"))
    same = lambda h: F.array_join(F.slice(F.col("__t"), h["pos"] + 1, h["n"]), " ") == h["term"]
    checked = toks.join(per_doc, id_col).select(id_col, F.filter("__hits", same).alias("__hits"))
    return checked.select(id_col, F.inline("__hits"))


def phrase_tags(docs: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, max_n: int = MAX_TOKENS,
                default: str | None = UNKNOWN_TAG) -> DataFrame:
    """``(id, tags, tag_list, n_matches)`` of every document: its taken terms, sorted and distinct, and how
    many places they were taken at.  No term, a null or an empty text: the ``default`` tag, no match."""
    order = lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(b["n"] - a["n"])
    hits = (phrase_hits(docs, id_col, text_col, dictionary, max_n).groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "term")), order).alias("__hits")))
    taken = hits.withColumn("__taken", _leftmost_longest(F.col("__hits")["pos"], F.col("__hits")["n"]))
    terms = F.filter(F.zip_with("__hits", "__taken", lambda h, t: F.when(t, h["term"])), lambda x: x.isNotNull())
    found = taken.select(id_col, F.array_sort(F.array_distinct(terms)).alias("tag_list"), F.size(terms).cast("long").alias("n_matches"))
    out = docs.select(id_col).join(found, id_col, "left").select(
        id_col, F.coalesce("tag_list", F.array().cast("array<string>")).alias("tag_list"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    tags: Column = F.array_join("tag_list", ",")
    if default is not None:
        tags = F.when(F.size("tag_list") == 0, F.lit(default)).otherwise(tags)
    return out.withColumn("tags", tags)
