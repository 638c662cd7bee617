"""Session factory with the settings the engine expects."""

from pyspark.sql import SparkSession


def session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer; conf overrides any of it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()
