"""A session with the settings the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "snagline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; partitions and memory stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
