"""A session with the settings the engine relies on."""

from pyspark.sql import SparkSession


def session(app: str = "wayfare", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, skew joins, RocksDB for streaming state; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return builder.config(map=defaults | conf).getOrCreate()
