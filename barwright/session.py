"""Session settings shared by the tests, the bench and the entry point."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", *, partitions: int = 8, memory: str = "8g", name: str = "barwright", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; conf overrides or adds settings (underscores for dots)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
