"""Session settings that suit these operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName("loomline")
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | more).getOrCreate()
