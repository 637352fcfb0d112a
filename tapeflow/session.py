"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tapeflow", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session time, adaptive execution with skew handling; other settings by keyword (dots as underscores don't apply)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in wanted.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
