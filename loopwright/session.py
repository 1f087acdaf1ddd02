"""Session factory with the settings the operators are tested under."""

from __future__ import annotations

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_session(name: str = "loopwright", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session pinned to UTC with adaptive execution on. Where spark-submit or the environment names a master, it stays; else the session is local."""
    SparkContext._ensure_initialized()
    builder = SparkSession.builder
    if not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "8g")
    return (
        builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
