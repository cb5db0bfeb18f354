"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lumenframe", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one: UTC, adaptive execution, Arrow. On a cluster master comes from spark-submit."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master or "MASTER" in os.environ:
        b = b.master(master or os.environ["MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    } | conf
    return b.config(map=settings).getOrCreate()
