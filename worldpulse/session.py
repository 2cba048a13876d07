"""The session that tests, the bench and scripts share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: str | int = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session in UTC. On a cluster, pass your own session to the library instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("worldpulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
