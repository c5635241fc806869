"""A session with the settings that the library is written for. Any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()
