"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideline.streaming.stateful import STATE_STORE


def session(name: str = "tideline", cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster the master and memory of spark-submit win."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | STATE_STORE | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()
