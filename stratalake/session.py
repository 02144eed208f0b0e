"""Session settings that every part of the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # columns are found by field id, so renamed and widened columns need no rewrite
    "spark.sql.parquet.fieldId.read.enabled": "true",
    "spark.sql.parquet.fieldId.write.enabled": "true",
    "spark.sql.parquet.fieldId.read.ignoreMissing": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def get_spark(master: str = "local[*]", app: str = "stratalake", **more: str) -> SparkSession:
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
