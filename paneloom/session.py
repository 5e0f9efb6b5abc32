"""The session that tests, the bench and small local runs use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g", name: str = "paneloom") -> SparkSession:
    """A local session: UTC, ANSI, adaptive plans, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
