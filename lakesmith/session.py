"""Session construction and the shared scratch location.

Library code never invents a machine-local folder: anything that must be
materialised goes under the folder named by ``spark.checkpoint.dir``.  Only
local-mode sessions (tests, benchmarks) get one assigned when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "lakesmith") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LAKESMITH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Read from the session; a local-mode session without one gets a fresh
    temporary folder (tests).  A cluster session without one is an error:
    a machine-local folder would not be visible to other executors.
    """
    current = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise RuntimeError(f"{_CKPT_KEY} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="lakesmith-ckpt-")
    spark.conf.set(_CKPT_KEY, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique directory under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` with a reliable ``checkpoint()`` into the shared
    checkpoint folder (survives executor loss; later consumers do not
    recompute the plan).  Used for small, bounded intermediates that several
    branches read, and where partitioning must be frozen."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
