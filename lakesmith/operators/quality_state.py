"""The quality report as mergeable state (A7, A8): one row of counts and a distinct-count sketch per batch.

A batch's state is made in one aggregate, stored under its batch, and merged with the others whenever the
report is wanted: counts add up, sketches unite.  No row is read twice, a replayed batch replaces its state.
Counts are exact; what depends on distinct names is an estimate with a relative standard error of about
``1.04 / sqrt(2 ** lg_k)`` (0.8 % by default, exact while names are few).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.text import non_empty

LG_K = 14
TOTAL, NO_NAME, SKETCH = "silver_total_rows", "missing_medicine_name_rows", "names"
#: Metrics that rest on the sketch.
ESTIMATED = ("gold_catalog_rows", "duplicate_medicine_rows_removed", "distinct_medicine_names")


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / sqrt(1 << lg_k)


def quality_state(silver: DataFrame, name_col: str, check_cols: Sequence[str] = (), dose_col: str | None = None,
                  dose_min_col: str | None = None, lg_k: int = LG_K) -> DataFrame:
    """One row of a batch: the counts of the report by metric name, and the sketch of its non-blank names.
    An empty batch gives zeros and an empty sketch."""
    blank = lambda c: ~non_empty(F.col(c).cast("string"))
    counts = {TOTAL: F.count(F.lit(1)), NO_NAME: F.count_if(blank(name_col))}
    counts |= {f"missing_{c}_rows": F.count_if(blank(c)) for c in check_cols}
    if dose_col and dose_min_col:
        counts[f"unparsable_{dose_col}_rows"] = F.count_if(~blank(dose_col) & F.col(dose_min_col).isNull())
    names = F.hll_sketch_agg(F.when(~blank(name_col), F.col(name_col).cast("string")), F.lit(lg_k))
    return silver.agg(*[c.alias(n) for n, c in counts.items()], names.alias(SKETCH))


def merge_states(states: DataFrame) -> DataFrame:
    """One state of many (a row each); columns that a state lacks count as zero."""
    counts = [c for c, t in states.dtypes if t == "bigint"]
    return states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.hll_union_agg(SKETCH).alias(SKETCH))


def report(state: DataFrame) -> DataFrame:
    """``(metric_name, metric_value)`` of a state: the metrics of the one-pass quality report."""
    names = F.coalesce(F.hll_sketch_estimate(SKETCH), F.lit(0))
    values = {c: F.col(c) for c, t in state.dtypes if t == "bigint"}
    values |= {ESTIMATED[0]: names, ESTIMATED[1]: F.greatest(F.col(TOTAL) - names, F.lit(0)), ESTIMATED[2]: names}
    return state.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric_name"), v.cast("long").alias("metric_value")) for n, v in values.items()])))
