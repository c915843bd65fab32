"""Sessions with the settings that the plans expect."""

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution and UTC; partition counts are the cluster's matter."""
    builder = SparkSession.builder.appName("stackwright")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return builder.config(map=settings).getOrCreate()
