"""The session settings that the engine's queries assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC, because the reference's timestamps are naive; adaptive execution, because partition
#: counts and skewed joins are settled from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "skylot", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with SETTINGS; master and partition count are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local") and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
        builder = builder.config("spark.driver.memory", extra.get("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
