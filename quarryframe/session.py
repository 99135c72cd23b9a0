"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", app_name: str = "quarryframe", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change while a session runs."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
