"""Raw -> bronze -> silver -> gold as DataFrame -> DataFrame functions (M1-M3).

Every function takes column names as parameters; the reference's domain
names are only defaults.  No function collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.schema import (
    business_columns,
    column_or_null,
    find_first_column,
    normalize_column_names,
    unique_columns,
)
from lakesmith.functions.text import (
    MEDICINE_FIELD_PATTERNS,
    clean_string,
    dose_bounds,
    extract_fields,
    leading_integer,
    non_empty,
    normalize_name,
    row_hash,
    search_text,
)
from lakesmith.operators.sequence import dense_id

# The reference's name-column candidates, gold schemas and statistics.
NAME_CANDIDATES = ("ten_cay_thuoc", "ten_thuoc", "name")
BRONZE_ID, SILVER_ID, GOLD_ID = "cd_bronze_id", "cd_silver_id", "cd_gold_medicine_id"
ID_AND_AUDIT = (BRONZE_ID, "dt_ingest_bronze", SILVER_ID, "dt_ingest_silver", "row_hash", "silver_processed_at")
CATALOG_COLUMNS = (
    ("medicine_name", "string"), ("medicine_alt_name", "string"), ("bo_phan_dung", "string"),
    ("cong_dung", "string"), ("lieu_dung", "string"), ("lieu_dung_min_g", "double"),
    ("lieu_dung_max_g", "double"), ("vi", "string"), ("tinh", "string"), ("quy_kinh", "string"),
    ("tinh_vi_quy_kinh", "string"), ("source_file", "string"), ("silver_row_hash", "string"),
)
DEFAULT_CATALOG_ROLES = {
    "medicine_alt_name": "ten_thuoc", "bo_phan_dung": "bo_phan_dung", "cong_dung": "cong_dung",
    "lieu_dung": "lieu_dung", "lieu_dung_min_g": "lieu_dung_min_g", "lieu_dung_max_g": "lieu_dung_max_g",
    "vi": "vi", "tinh": "tinh", "quy_kinh": "quy_kinh", "tinh_vi_quy_kinh": "tinh_vi_quy_kinh",
    "source_file": "_source_file", "silver_row_hash": "row_hash",
}
GOLD_HASH_COLUMNS = ("medicine_name", "medicine_alt_name", "bo_phan_dung", "cong_dung", "lieu_dung", "vi", "tinh", "quy_kinh")
SEARCH_COLUMNS = GOLD_HASH_COLUMNS + ("tinh_vi_quy_kinh",)
DEFAULT_STAT_DIMENSIONS = (
    ("tinh", "medicine_count_by_tinh"), ("vi", "medicine_count_by_vi"),
    ("quy_kinh", "medicine_count_by_quy_kinh"), ("source_file", "medicine_count_by_source_file"),
)
TOTAL_STAT = ("medicine_total", "all", "all")


# --------------------------------------------------------------------------- bronze (M1)

def to_bronze(
    df: DataFrame,
    order: Sequence[str | Column],
    source_file: Column,
    source_uri: Column | None = None,
    start_id: int | Column = 1,
    with_timestamps: bool = True,
) -> DataFrame:
    """Business columns as strings under sanitised unique names,
    a dense ``cd_bronze_id`` continuing at ``start_id`` in ``order``, and the
    audit columns.  ``source_file`` / ``source_uri`` are usually derived from
    ``_metadata.file_path``."""
    data = business_columns(df)
    names = unique_columns(data)
    ided = dense_id(df.withColumns({"_source_file": source_file,
                                    "_source_uri": source_uri if source_uri is not None else source_file}),
                    order, name=BRONZE_ID, start=start_id)
    cols = [F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(data, names)]
    out = ided.select(*cols, F.col(BRONZE_ID), "_source_file", "_source_uri")
    if with_timestamps:
        now = F.current_timestamp()
        out = out.withColumns({
            "dt_ingest_bronze": now,
            "_ingested_at": now,
            "_ingestion_date": F.date_format(now, "yyyy-MM-dd"),
        })
    return out


def next_id(existing: DataFrame | None, id_col: str) -> Column:
    """A1: ``coalesce(max(id), 0) + 1`` of an existing table as a scalar
    subquery column (no collect); 1 when there is no table."""
    if existing is None:
        return F.lit(1).cast("long")
    return existing.select((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("long")).scalar()


# --------------------------------------------------------------------------- silver (M2)

def clean_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P6 on every (string) business column; others unchanged."""
    targets = set(cols if cols is not None else business_columns(df))
    types = dict(df.dtypes)
    return df.select(*[
        clean_string(F.col(f"`{c}`")).alias(c) if c in targets and types[c] == "string" else F.col(f"`{c}`")
        for c in df.columns
    ])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """A2/A3: one row per ``keys`` — the first in ``order`` (deterministic).

    ``min_by`` over a struct aggregates partially on the map side, so a key
    holding a third of the rows ships one partial row per map task."""
    others = [c for c in df.columns if c not in set(keys)]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    if not others:
        return df.select(*keys).distinct()
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), ordering).alias("__first"))
            .select(*keys, "__first.*"))


def merge_by_name(df: DataFrame, name_col: str, order_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: per name, for every column independently the first non-NULL
    value in ``order_col`` order; ``order_col`` becomes the name's first order."""
    cols = [c for c in (cols if cols is not None else df.columns) if c not in (name_col, order_col)]
    aggs = [F.expr(f"min_by(`{c}`, `{order_col}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in cols]
    return df.groupBy(name_col).agg(F.min(order_col).alias(order_col), *aggs)


def to_silver(
    bronze: DataFrame,
    name_candidates: Sequence[str] = NAME_CANDIDATES,
    order_col: str = BRONZE_ID,
    field_source: str = "tinh_vi_quy_kinh",
    field_patterns: Mapping[str, str] = MEDICINE_FIELD_PATTERNS,
    dose_col: str = "lieu_dung",
    int_cols: Sequence[str] = ("stt",),
    start_id: int | Column = 1,
    with_timestamps: bool = True,
) -> DataFrame:
    """M2: normalise names (P5), clean text (P7), leading integers (P8),
    drop nameless rows (P10) or all-NULL rows (P11), field captures (P14),
    dose bounds (P15), merge by name (A4) or exact-row dedup (A2), row hash
    (P16), dense silver id (W1) in first-seen order.

    Ids/audit columns are never treated as data (they made every row unique
    in the reference's dedup and hash)."""
    df = normalize_column_names(bronze)
    exclude = [c for c in ID_AND_AUDIT if c in df.columns]
    data = business_columns(df, exclude)
    df = clean_columns(df, data)
    for c in int_cols:
        if c in df.columns:
            df = df.withColumn(c, leading_integer(c))
    name = find_first_column(df, name_candidates)
    if name:
        df = df.where(non_empty(name)).withColumn(name, normalize_name(name))
    elif data:
        df = df.na.drop(how="all", subset=data)
    if field_source in df.columns:
        df = df.withColumns(extract_fields(field_source, field_patterns))
    if dose_col in df.columns:
        lo, hi = dose_bounds(dose_col)
        df = df.withColumns({f"{dose_col}_min_g": lo, f"{dose_col}_max_g": hi})
    data = business_columns(df, exclude)
    keep = [c for c in df.columns if c not in exclude or c == order_col]
    df = df.select(*keep)
    if name:
        # A2 before A4 is provably redundant: dropping later exact copies never
        # changes a first-non-NULL-in-order merge, so it is not executed.
        merged = merge_by_name(df, name, order_col)
    else:
        merged = keep_first(df, data, [order_col])
    silver = merged.withColumn("row_hash", row_hash(data))
    silver = dense_id(silver, [order_col], name=SILVER_ID, start=start_id)
    if with_timestamps:
        silver = silver.withColumns({"silver_processed_at": F.current_timestamp(),
                                     "dt_ingest_silver": F.current_timestamp()})
    return silver


# --------------------------------------------------------------------------- gold (M3)

def gold_catalog(silver: DataFrame, roles: Mapping[str, str] | None = None,
                 name_candidates: Sequence[str] = NAME_CANDIDATES, with_timestamps: bool = True) -> DataFrame:
    """Fixed catalog schema from optional silver columns,
    blank names dropped, one row per name, gold hash, dense id by name."""
    roles = dict(DEFAULT_CATALOG_ROLES, **(roles or {}))
    name = roles.get("medicine_name") or find_first_column(silver, name_candidates)
    roles["medicine_name"] = name
    order_col = SILVER_ID if SILVER_ID in silver.columns else None
    if roles["source_file"] not in silver.columns:
        roles["source_file"] = "source_file"
    sel = [column_or_null(silver, roles.get(t), t, dtype) for t, dtype in CATALOG_COLUMNS]
    if order_col:
        sel.append(F.col(order_col).alias("__ord"))
    cat = silver.select(*sel)
    if name:
        cat = cat.where(non_empty("medicine_name"))
    cat = keep_first(cat, ["medicine_name"], ["__ord"] if order_col else [c for c, _ in CATALOG_COLUMNS])
    cat = cat.drop("__ord").withColumn("gold_row_hash", row_hash(GOLD_HASH_COLUMNS))
    cat = dense_id(cat, ["medicine_name"], name=GOLD_ID)
    if with_timestamps:
        cat = cat.withColumn("gold_processed_at", F.current_timestamp())
    return cat


def gold_search(catalog: DataFrame, with_timestamps: bool = True) -> DataFrame:
    """P17."""
    out = catalog.select(GOLD_ID, "medicine_name", search_text(SEARCH_COLUMNS).alias("search_text"),
                         "source_file", "gold_row_hash")
    return out.withColumn("gold_processed_at", F.current_timestamp()) if with_timestamps else out


def gold_stats(catalog: DataFrame, dimensions: Sequence[tuple[str, str]] = DEFAULT_STAT_DIMENSIONS,
               with_timestamps: bool = True) -> DataFrame:
    """Per-dimension counts (blank values excluded) plus the grand
    total, in one scan with GROUPING SETS (one Expand, one shuffle)."""
    dims = [(c, s) for c, s in dimensions if c in catalog.columns]
    cols = [c for c, _ in dims]
    sets = [[F.col(c)] for c in cols] + [[]]
    g = catalog.groupingSets(sets, *cols) if cols else catalog.groupBy()
    agg = g.agg(F.count(F.lit(1)).alias("record_count"),
                *([F.grouping_id().alias("__gid")] if cols else []))
    if not cols:
        out = agg.select(*[F.lit(v).alias(n) for v, n in zip(TOTAL_STAT, ("statistic_name", "dimension_name", "dimension_value"))],
                         "record_count")
    else:
        full = (1 << len(cols)) - 1
        stat = F.lit(TOTAL_STAT[0])
        dim = F.lit(TOTAL_STAT[1])
        val = F.lit(TOTAL_STAT[2])
        keep = F.col("__gid") == full
        for i, (c, s) in enumerate(dims):
            gid = full ^ (1 << (len(cols) - 1 - i))
            is_set = F.col("__gid") == gid
            stat = F.when(is_set, F.lit(s)).otherwise(stat)
            dim = F.when(is_set, F.lit(c)).otherwise(dim)
            val = F.when(is_set, F.col(c).cast("string")).otherwise(val)
            keep = keep | (is_set & non_empty(F.col(c).cast("string")))
        out = agg.where(keep).select(stat.alias("statistic_name"), dim.alias("dimension_name"),
                                     val.alias("dimension_value"), F.col("record_count").cast("long"))
    return out.withColumn("gold_processed_at", F.current_timestamp()) if with_timestamps else out


def quality_report(silver: DataFrame, name_col: str | None = None,
                   check_cols: Sequence[str] = ("cong_dung", "lieu_dung", "bo_phan_dung", "tinh_vi_quy_kinh"),
                   dose_col: str = "lieu_dung", dose_min_col: str = "lieu_dung_min_g",
                   name_candidates: Sequence[str] = NAME_CANDIDATES, with_timestamps: bool = True) -> DataFrame:
    """The data-quality metrics in ONE aggregate pass, unpivoted.

    ``gold_catalog_rows`` is the number of distinct non-blank names — exactly
    the catalog's row count (one row per non-blank name) — so the catalog is
    not scanned again.  ``duplicate_medicine_rows_removed`` keeps the
    reference formula ``max(total - catalog, 0)``."""
    name = name_col or find_first_column(silver, name_candidates)
    metrics: list[tuple[str, Column]] = [("silver_total_rows", F.count(F.lit(1)))]
    if name:
        distinct = F.count_distinct(F.when(non_empty(name), F.col(name)))
        metrics += [("gold_catalog_rows", distinct),
                    ("duplicate_medicine_rows_removed", F.greatest(F.count(F.lit(1)) - distinct, F.lit(0))),
                    ("missing_medicine_name_rows", F.count_if(~non_empty(name))),
                    ("distinct_medicine_names", distinct)]
    else:
        # all names are NULL: the catalog keeps one row of them
        total = F.count(F.lit(1))
        kept = F.least(total, F.lit(1))
        metrics += [("gold_catalog_rows", kept), ("duplicate_medicine_rows_removed", total - kept)]
    for c in check_cols:
        if c in silver.columns:
            metrics.append((f"missing_{c}_rows", F.count_if(~non_empty(F.col(c).cast("string")))))
    if dose_col in silver.columns and dose_min_col in silver.columns:
        metrics.append((f"unparsable_{dose_col}_rows",
                        F.count_if(non_empty(F.col(dose_col).cast("string")) & F.col(dose_min_col).isNull())))
    wide = silver.agg(*[m.cast("long").alias(f"m{i}") for i, (_, m) in enumerate(metrics)])
    stack = ", ".join(f"'{n}', m{i}" for i, (n, _) in enumerate(metrics))
    out = wide.selectExpr(f"stack({len(metrics)}, {stack}) AS (metric_name, metric_value)")
    return out.withColumn("gold_processed_at", F.current_timestamp()) if with_timestamps else out


def to_gold(silver: DataFrame, roles: Mapping[str, str] | None = None,
            dimensions: Sequence[tuple[str, str]] = DEFAULT_STAT_DIMENSIONS,
            quality_kwargs: Mapping[str, object] | None = None, with_timestamps: bool = True) -> dict[str, DataFrame]:
    """M3: the four gold tables."""
    catalog = gold_catalog(silver, roles, with_timestamps=with_timestamps)
    return {
        "medicine_catalog": catalog,
        "medicine_search": gold_search(catalog, with_timestamps),
        "medicine_stats": gold_stats(catalog, dimensions, with_timestamps),
        "quality_report": quality_report(silver, with_timestamps=with_timestamps, **(quality_kwargs or {})),
    }
