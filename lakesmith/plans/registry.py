"""Query name -> Spark callable / oracle SQL (names follow SURVEY §7.3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesmith.plans import medallion_queries as MQ
from lakesmith.plans import retrieval_queries as RQ
from lakesmith.plans import conversation_queries as CQ
from lakesmith.plans import derived_queries as DQ
from lakesmith.plans import ingest_queries as IQ
from lakesmith.plans import job_queries as JQ
from lakesmith.plans import stream_queries as SQ


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in (MQ, RQ, CQ, IQ, DQ, SQ, JQ):
        for k, v in vars(mod).items():
            if k.startswith("q_") and callable(v):
                out[k[2:]] = v
    return out


def oracle_queries() -> dict[str, str]:
    from lakesmith.plans.oracle import conversation_sql, ingest_sql, medallion_sql, norm_text, retrieval_sql
    out = {}
    out.update(medallion_sql())
    out.update(retrieval_sql())
    out.update(conversation_sql())
    out.update(ingest_sql())
    out.update(DQ.SQL)
    out.update({k: v.replace("{norm}", norm_text("text")) for k, v in SQ.SQL.items()})
    out.update(JQ.sql())
    return out
