"""Session defaults for the engine; what a cluster or a running session has set always wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Scans are built from very many small expressions; recording where each was made costs more
    # than making it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Streaming state is kept off the JVM heap so that it can outgrow it.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app_name: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    running = SparkSession.getActiveSession()
    # The submit flags and the defaults file, as the JVM read them, or a running session's own.
    spark = running or builder.getOrCreate()
    launched = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if key not in conf and not launched.contains(key) and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
