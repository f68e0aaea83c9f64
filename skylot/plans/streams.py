"""The batch forms of the streaming operators, which the tests hold against the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylot.functions.scalars import q6
from skylot.plans.twins import q6 as q
from skylot.registry import query
from skylot.sources.lens import table
from skylot.streaming.windows import tumbling


@query("stream_window_counts", f"SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {q('sum(CAST(FLOOR(value * 1e6 + 5e-1) AS BIGINT)) / 1e6')} AS weight_kg FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Five minutes divide a day, so the epoch's windows are midnight's."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.floor(F.col("value") * 1e6 + 0.5))
    return tumbling(events).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", q6(F.col("weight_kg") / 1e6).alias("weight_kg"))


@query("sessions", "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def sessions(spark, d):
    """An extension: a requester's sessions, two hours without an event apart."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    each = events.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
