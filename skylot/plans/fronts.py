"""Queries over candidate plans: skylines, extremes, representatives, backends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions.scalars import q6
from skylot.operators import pareto
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_candidate
from skylot.registry import query
from skylot.sources.lens import OBJECTIVES, candidates

_NO_WORSE = " AND ".join(f"b.{o} <= a.{o}" for o in OBJECTIVES)
_BETTER = " OR ".join(f"b.{o} < a.{o}" for o in OBJECTIVES)
_FRONT = f"SELECT * FROM v_candidate a WHERE NOT EXISTS (SELECT 1 FROM v_candidate b WHERE {_NO_WORSE} AND ({_BETTER}))"
_SCALED = ", ".join(f"coalesce(({o} - min({o}) OVER ()) / nullif(max({o}) OVER () - min({o}) OVER (), 0), 0) AS {o}" for o in OBJECTIVES)


def _out(rows):
    return rows.select("solution_id", *(q6(F.col(o)).alias(o) for o in OBJECTIVES))


_COLUMNS = ", ".join(f"{q(o)} AS {o}" for o in OBJECTIVES)


@query("pareto_frontier", with_candidate(f"SELECT solution_id, {_COLUMNS} FROM ({_FRONT})"))
def pareto_frontier(spark, d):
    return _out(pareto.frontier(candidates(spark, d), OBJECTIVES))


@query("pareto_extremes", with_candidate(" UNION ALL ".join(
    f"SELECT '{o}' AS metric, arg_min(solution_id, ({o}, solution_id)) AS best, arg_max(solution_id, ({o}, -solution_id)) AS worst, {q(f'max({o}) - min({o})')} AS spread FROM v_candidate" for o in OBJECTIVES)))
def pareto_extremes(spark, d):
    long = candidates(spark, d).unpivot("solution_id", list(OBJECTIVES), "metric", "value")
    return long.groupBy("metric").agg(F.min_by("solution_id", F.struct("value", "solution_id")).alias("best"),
                                      F.max_by("solution_id", F.struct("value", -F.col("solution_id"))).alias("worst"), q6(F.max("value") - F.min("value")).alias("spread"))


@query("parallel_coords", with_candidate(f"SELECT solution_id, {_COLUMNS} FROM (SELECT solution_id, {_SCALED} FROM v_candidate)"))
def parallel_coords(spark, d):
    return _out(pareto.normalized(candidates(spark, d), OBJECTIVES))


@query("representative_point", with_candidate(f"SELECT solution_id, {q('score')} AS score FROM (SELECT solution_id, {' + '.join(OBJECTIVES)} AS score FROM (SELECT solution_id, {_SCALED} FROM ({_FRONT}))) ORDER BY score, CAST(solution_id AS VARCHAR) LIMIT 1"))
def representative_point(spark, d):
    """The front's plan with the least sum of its scaled objectives; of equal ones the first id, read as text."""
    scaled = pareto.normalized(pareto.frontier(candidates(spark, d), OBJECTIVES), OBJECTIVES)
    score = sum((F.col(o) for o in OBJECTIVES[1:]), F.col(OBJECTIVES[0]))
    return scaled.select("solution_id", q6(score).alias("s")).orderBy("s", F.col("solution_id").cast("string")).limit(1).select("solution_id", q6(F.col("s")).alias("score"))


@query("dominated_by_main", with_candidate(f"SELECT a.solution_id FROM v_candidate a JOIN v_candidate b ON b.solution_id = (SELECT arg_min(solution_id, (distance, solution_id)) FROM v_candidate) AND {_NO_WORSE} AND ({_BETTER})"))
def dominated_by_main(spark, d):
    rows = candidates(spark, d)
    main = rows.orderBy("distance", "solution_id").limit(1)
    return rows.alias("x").join(F.broadcast(main).alias("y"), pareto.dominates(OBJECTIVES, "y", "x")).select("x.solution_id")  # main is one row


@query("best_backend", with_candidate(" UNION ALL ".join(f"SELECT '{o}' AS metric, arg_min(backend, (v, backend)) AS backend, {q('min(v)')} AS value FROM (SELECT solution_id % 4 AS backend, avg({o}) AS v FROM v_candidate GROUP BY 1)" for o in OBJECTIVES)))
def best_backend(spark, d):
    means = candidates(spark, d).groupBy((F.col("solution_id") % 4).alias("backend")).agg(*(F.avg(o).alias(o) for o in OBJECTIVES))
    long = means.unpivot("backend", list(OBJECTIVES), "metric", "value")
    return long.groupBy("metric").agg(F.min_by("backend", F.struct("value", "backend")).alias("backend"), q6(F.min("value")).alias("value"))


@query("weight_profiles", with_candidate("SELECT profile, arg_min(solution_id, (" + q("w1 * distance + w2 * delivery_time + w3 * noise") + ", solution_id)) AS solution_id FROM v_candidate CROSS JOIN (VALUES ('balanced', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('distance', 5.0, 0.5, 0.5), ('time', 0.5, 5.0, 0.5), ('quiet', 0.5, 0.5, 5.0)) p(profile, w1, w2, w3) GROUP BY profile"))
def weight_profiles(spark, d):
    """A weighted-sum scan: each profile's best plan."""
    profiles = spark.createDataFrame([("balanced", 1.0, 1.0, 1.0), ("distance", 5.0, 0.5, 0.5), ("time", 0.5, 5.0, 0.5), ("quiet", 0.5, 0.5, 5.0)], "profile string, w1 double, w2 double, w3 double")
    value = q6(F.col("w1") * F.col("distance") + F.col("w2") * F.col("delivery_time") + F.col("w3") * F.col("noise"))
    return candidates(spark, d).crossJoin(F.broadcast(profiles)).groupBy("profile").agg(F.min_by("solution_id", F.struct(value.alias("v"), "solution_id")).alias("solution_id"))  # four rows


@query("objective_ranks", with_candidate("SELECT solution_id, CAST(rank() OVER (ORDER BY distance) AS BIGINT) AS by_distance, CAST(dense_rank() OVER (ORDER BY drones) AS BIGINT) AS by_drones FROM v_candidate"))
def objective_ranks(spark, d):
    rows = candidates(spark, d)
    # ranks of distinct values: how many rows, and how many values, are below
    def below(column: str, n: str, name: str):
        values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        coarse = F.floor(F.col(column) / 1000)
        start = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("_c").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        marked = values.withColumns({"_c": coarse, "_w": F.expr(n)})
        starts = marked.groupBy("_c").agg(F.sum("_w").alias("_all")).select("_c", F.coalesce(F.sum("_all").over(start), F.lit(0)).alias("_start"))
        return marked.withColumn("_b", F.coalesce(F.sum("_w").over(within), F.lit(0))).join(starts, "_c").select(
            column, (F.col("_start") + F.col("_b") + 1).cast("long").alias(name))
    return rows.join(below("distance", "_n", "by_distance"), "distance").join(below("drones", "1", "by_drones"), "drones").select("solution_id", "by_distance", "by_drones")
