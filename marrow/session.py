"""Session settings that the semantics and the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: UTC for dates, ANSI so that a wrong cast is an error (try_ functions are used where it must not be), AQE for skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("marrow")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver and executors share.  Where it is unset
    and driver and executors are one process (tests) it is one of our own; a cluster without it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_marrow_shared", None)
    if own is None:
        own = spark.sparkContext._marrow_shared = "file://" + tempfile.mkdtemp(prefix="marrow-")
    return own
