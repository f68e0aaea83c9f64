"""Structured Streaming variants: tumbling window counts and per-user fleet state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream; ts as a timestamp with a zone, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Demands a window and type; windows are given out once the watermark has passed them."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("weight_kg"))
            .select(F.col("w.start").alias("start"), "event_type", "n", "weight_kg"))


FLEET = "user_id long, trips long, last_type string, busy_s double"
_NEXT = {"idle": "to_supply", "to_supply": "to_demand", "to_demand": "returning", "returning": "idle"}


def fleet(events: DataFrame) -> DataFrame:
    """A state machine a key: every event moves idle -> to_supply -> to_demand -> returning -> idle; a trip
    is complete when it is idle again. Time between events of one trip counts as busy."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, trips, busy, last = state.get if state.exists else ("idle", 0, 0.0, 0.0)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for ts in rows["ts"]:
            now = ts.timestamp()
            busy += now - last if place != "idle" else 0.0
            place, last = _NEXT[place], now
            trips += place == "idle"
        state.update((place, trips, busy, last))
        yield pd.DataFrame({"user_id": [key[0]], "trips": [trips], "last_type": [place], "busy_s": [busy]})

    return events.groupBy("user_id").applyInPandasWithState(step, FLEET, "place string, trips long, busy double, last double", "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give its output as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
