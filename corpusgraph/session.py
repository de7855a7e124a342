"""Session defaults."""

from pyspark.sql import SparkSession


def session(name: str = "corpusgraph", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; partition counts are left to the cluster and to adaptive coalescing."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
