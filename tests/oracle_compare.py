"""Run queries() against oracle_sql() with DuckDB and compare multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, "/root/repo")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    rows = sdf.select(*cols).collect()
    t1 = time.time()
    res = {"query": name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    if sorted(dcols) != cols:
        res["status"] = f"COLUMNS spark={cols} duck={sorted(dcols)}"
        return res
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    wrong = {c: (stypes[c], dtypes[c]) for c in cols if stypes[c] != dtypes[c]}
    if wrong:
        res["status"] = f"TYPES {wrong}"
        return res
    drows = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    res["duck_rows"] = len(drows)
    a = Counter(tuple(_norm(r[c]) for c in cols) for r in rows)
    b = Counter(tuple(_norm(x) for x in r) for r in drows)
    if a == b:
        res["status"] = "MATCH"
    else:
        res["status"] = "MISMATCH"
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        res["spark_only"] = [str(x)[:300] for x in only_a]
        res["duck_only"] = [str(x)[:300] for x in only_b]
    return res


if __name__ == "__main__":
    from lakesmith.session import build_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, sf, name, fn, sqls.get(name), con)
        except Exception as e:  # report and continue
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("MATCH", "rows-only")
        print(r, flush=True)
    print("NOT OK:", bad)
