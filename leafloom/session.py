"""A Spark session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build(name: str = "leafloom", *, cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """The session that there is, or one as submitted. Only where nothing was submitted, a local one of ``cores`` threads is
    made; the number of shuffle partitions is set only where it is given."""
    builder = SparkSession.builder.appName(name)
    if SparkSession.getActiveSession() is None and not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
