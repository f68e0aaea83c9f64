"""The driver's tables, seen as demands, delivery facts, candidate plans and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylot.functions import rules
from skylot.functions.scalars import minute_of_day, window_label

#: Names that the keys of a row choose from (fixed values).
ROLES = ("emergency_doctor", "icu_nurse", "consumer", "paramedic", "ward_coordinator", "community_worker")
CARGO = ("aed", "ventilator", "otc_drug", "vaccine", "blood_product", "icu_drug", "food")
PLACES = ("hospital", "clinic", "residential_area", "community")
TEXTS = ("cardiac arrest reported", "icu ventilator needed", "standing by at gate", "routine refill", "post-exposure kit", "child with fever")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def demands(spark: SparkSession, sf_dir: str, width: int = 5) -> DataFrame:
    """One row a demand, with its window, score and priority."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("event_id").alias("demand_id"), "ts", "user_id", "event_type", F.col("value").alias("weight_kg"), k.alias("k"))
    tier = F.when(F.col("event_type") == "error", "life_support").when(F.col("event_type") == "purchase", "critical").when(
        F.col("event_type") == "signup", "regular").otherwise("consumer")
    deadline = F.when(F.col("k") < 10, 15).when(F.col("k") < 25, 30).when(F.col("k") < 50, 60).when(F.col("k") < 80, 120)
    e = e.select("*", window_label(F.col("ts"), width).alias("label"), F.floor(minute_of_day(F.col("ts")) / 5).cast("int").alias("slot"),
                 tier.alias("tier"), deadline.alias("deadline"), _pick(ROLES, F.col("user_id")).alias("role"),
                 _pick(CARGO, F.col("demand_id")).alias("cargo"), _pick(PLACES, F.col("user_id")).alias("destination"),
                 _pick(TEXTS, F.col("k")).alias("text"), (F.col("k") % 11 == 0).alias("children"), (F.col("k") % 13 == 0).alias("elderly"),
                 (F.col("k") % 7 == 0).alias("vulnerable"), F.when(F.col("k") % 3 == 0, "cold_chain").when(F.col("k") % 3 == 1, "shock_protection").alias("handling"),
                 (F.col("k") % 2 == 0).alias("ready"))
    hard = F.coalesce(F.col("deadline") <= 30, F.lit(False)) | F.col("tier").isin("life_support", "critical")
    return scored(e.withColumn("hard", hard))


def scored(rows: DataFrame) -> DataFrame:
    """Rows of demand fields with score, solver_score, reasons and priority."""
    c = F.col
    given = [c(x) for x in ("tier", "deadline", "hard", "cargo", "text", "role", "children", "elderly", "vulnerable", "handling", "destination")]
    found, solver = rules.factors(*given), rules.factors(*given, ready=c("ready"))
    rows = rows.withColumns({"score": rules.score(c("tier"), found), "solver_score": rules.score(c("tier"), solver), "reasons": rules.reasons(c("tier"), found)})
    return rows.withColumn("priority", rules.priority(c("score"), c("tier"), c("deadline"), c("cargo"), c("text")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a delivery: method, true and predicted priority, latency and deadline in minutes, served."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(order, line["l_orderkey"] == order["o_orderkey"])
    true = F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int"))
    predicted = F.when(F.col("l_quantity") <= 12, 1).when(F.col("l_quantity") <= 25, 2).when(F.col("l_quantity") <= 38, 3).otherwise(4)
    latency = F.greatest(F.lit(0), F.date_diff("l_shipdate", "o_orderdate")).cast("double")
    rows = rows.select(F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("demand_id"), F.col("l_suppkey").alias("carrier"),
                       F.col("l_partkey").alias("part"), true.alias("true_priority"), predicted.alias("pred_priority"), latency.alias("latency"),
                       (F.col("l_linestatus") == "F").alias("served"), (F.col("o_custkey") % 5 == 0).alias("vulnerable"),
                       F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"), F.col("l_quantity").alias("quantity"),
                       F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))
    return rows.withColumn("deadline", (F.col("true_priority") * 300).cast("double")).withColumn(
        "on_time", F.col("served") & (F.col("latency") <= F.col("deadline")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a plan (a carrier), with five objectives to minimise."""
    return facts(spark, sf_dir).groupBy(F.col("carrier").alias("solution_id")).agg(
        F.sum("quantity").alias("distance"), (F.sum("latency") / F.count(F.lit(1))).alias("delivery_time"),
        F.sum(F.floor(F.col("tax") * 100 + 0.5).cast("long")).cast("double").alias("noise"),
        (1 - F.avg(F.col("served").cast("double"))).alias("service_loss"), F.count_distinct("part").cast("double").alias("drones"))


OBJECTIVES = ("distance", "delivery_time", "noise", "service_loss", "drones")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand sites: customers at places that their keys name."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("site_id"), *_place(F.col("c_custkey"), 7919, 104729))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station_id"), *_place(F.col("s_suppkey"), 6101, 9973))


def _place(key: Column, a: int, b: int) -> tuple[Column, Column]:
    return (F.lit(113.8) + key * a % 10007 / 10007.0 * 0.5).alias("lon"), (F.lit(22.4) + key * b % 10009 / 10009.0 * 0.5).alias("lat")
