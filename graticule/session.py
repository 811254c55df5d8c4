"""One way to make a session that suits the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "graticule", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow batches that fit a worker; `conf` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
