"""Queries that hold predictions against the truth by keys, mine windows, and roll reports up."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions.scalars import q6
from skylot.operators import metrics, ranking
from skylot.operators.metrics import ratio
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_candidate, with_demand, with_fact, with_site
from skylot.registry import query
from skylot.sources import lens
from skylot.sources.lens import OBJECTIVES, candidates, facts, sites

#: Predictions of some demands, in two generations of files of which the later counts.
_PREDICTED = "SELECT label, demand_id, k % 4 + 1 AS predicted, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 5 + 1 END AS rank FROM v_demand WHERE k % 7 <> 0"


def predictions(rows):
    return rows.filter("k % 7 <> 0").select("label", "demand_id", (F.col("k") % 4 + 1).alias("predicted"), F.when(F.col("k") % 6 != 0, F.col("k") % 5 + 1).alias("rank"))


@query("aligned_predictions", with_demand(f"""SELECT p.label, p.demand_id, coalesce(CASE WHEN t.k % 3 <> 0 THEN 'E' || t.demand_id END, 'D' || t.demand_id) AS event_id, p.predicted, t.priority AS truth
  FROM ({_PREDICTED}) p JOIN v_demand t ON p.label = t.label AND p.demand_id = t.demand_id WHERE t.k % 11 <> 0"""))
def aligned_predictions(spark, d):
    """Predictions with the demands of their window and the truth of their event; what lacks either is left out."""
    rows = lens.demands(spark, d)
    demands = rows.select("label", "demand_id", F.when(F.col("k") % 3 != 0, F.concat(F.lit("E"), F.col("demand_id").cast("string"))).alias("source_event_id"))
    dialogues = rows.select(F.col("demand_id"), F.concat(F.lit("D"), F.col("demand_id").cast("string")).alias("dialogue_event"))
    truth = rows.filter("k % 11 <> 0").select("demand_id", F.col("priority").alias("truth"))
    both = predictions(rows).join(demands, ["label", "demand_id"]).join(dialogues, "demand_id", "left").join(truth, "demand_id")
    return both.select("label", "demand_id", F.coalesce("source_event_id", "dialogue_event").alias("event_id"), "predicted", "truth")


@query("prediction_accuracy", with_demand(f"SELECT count(*) AS n, {q('avg(CASE WHEN predicted = priority THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM ({_PREDICTED}) p JOIN v_demand t ON p.label = t.label AND p.demand_id = t.demand_id"))
def prediction_accuracy(spark, d):
    rows = lens.demands(spark, d)
    both = predictions(rows).join(rows.select("label", "demand_id", "priority"), ["label", "demand_id"])
    return both.agg(F.count(F.lit(1)).alias("n"), q6(F.avg((F.col("predicted") == F.col("priority")).cast("double"))).alias("accuracy"))


@query("operational_rows", with_fact("""SELECT f.method, f.demand_id, f.part, o_custkey AS event_id, f.true_priority, CASE WHEN f.served THEN f.latency END AS latency, coalesce(f.served AND f.latency <= f.deadline, false) AS in_time
  FROM v_fact f JOIN orders ON o_orderkey = demand_id WHERE o_orderstatus <> 'P'"""))
def operational_rows(spark, d):
    """Deliveries with their order's event and truth; those without a truth are left out, unserved ones have no latency."""
    truth = lens.table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("demand_id"), F.col("o_custkey").alias("event_id"))
    rows = facts(spark, d).join(truth, "demand_id", "left").filter("event_id IS NOT NULL")
    return rows.select("method", "demand_id", "part", "event_id", "true_priority", F.when(F.col("served"), F.col("latency")).alias("latency"),
                       F.coalesce(F.col("served") & (F.col("latency") <= F.col("deadline")), F.lit(False)).alias("in_time"))


@query("fallback_fields", with_demand("SELECT a.demand_id, coalesce(b.tier, a.tier_said) AS tier, coalesce(b.weight_kg, 1.0) AS weight_kg, b.demand_id IS NOT NULL AS known FROM (SELECT demand_id, CASE WHEN k % 2 = 0 THEN 'regular' END AS tier_said FROM v_demand) a LEFT JOIN (SELECT demand_id, tier, weight_kg FROM v_demand WHERE k % 4 <> 1) b ON a.demand_id = b.demand_id"))
def fallback_fields(spark, d):
    """Facts with their manifest's fields, field by field their own where the manifest has none."""
    rows = lens.demands(spark, d)
    manifest = rows.filter("k % 4 <> 1").select("demand_id", "tier", "weight_kg", F.lit(True).alias("there"))
    own = rows.select("demand_id", F.when(F.col("k") % 2 == 0, "regular").alias("tier_said"))
    return own.join(manifest, "demand_id", "left").select("demand_id", F.coalesce("tier", "tier_said").alias("tier"), F.coalesce("weight_kg", F.lit(1.0)).alias("weight_kg"), F.coalesce("there", F.lit(False)).alias("known"))


@query("repaired_priorities", with_demand("SELECT demand_id, CASE WHEN k % 5 <> 0 THEN priority WHEN k % 3 = 0 THEN 2 ELSE 4 END AS latent_priority, k % 5 = 0 AND k % 3 <> 0 AS defaulted FROM v_demand"))
def repaired_priorities(spark, d):
    """Records without a latent priority get their event's, else their own, else 4."""
    rows = lens.demands(spark, d)
    events = rows.filter("k % 5 <> 0").select("demand_id", F.col("priority").alias("of_event"))
    kept = rows.select("demand_id", F.when(F.col("k") % 3 == 0, 2).alias("own")).join(events, "demand_id", "left")
    return kept.select("demand_id", F.coalesce("of_event", "own", F.lit(4)).alias("latent_priority"), (F.col("of_event").isNull() & F.col("own").isNull()).alias("defaulted"))


@query("serialized_results", with_demand(f"SELECT t.label, t.demand_id, coalesce(p.predicted, 3) AS priority, p.rank AS window_rank, CASE WHEN t.k % 4 <> 0 THEN 'DR' || (t.k % 9) END AS drone FROM v_demand t LEFT JOIN ({_PREDICTED}) p ON p.label = t.label AND p.demand_id = t.demand_id"))
def serialized_results(spark, d):
    """Each demand with its configuration, of which the priority falls back to 3, and its assignment."""
    rows = lens.demands(spark, d)
    assigned = rows.filter("k % 4 <> 0").select("label", "demand_id", F.concat(F.lit("DR"), (F.col("k") % 9).cast("string")).alias("drone"))
    both = rows.select("label", "demand_id").join(predictions(rows), ["label", "demand_id"], "left").join(assigned, ["label", "demand_id"], "left")
    return both.select("label", "demand_id", F.coalesce("predicted", F.lit(3)).alias("priority"), F.col("rank").alias("window_rank"), "drone")


@query("obstacle_sites", with_site("SELECT site_id FROM v_site s WHERE site_id % 50 > 30 AND NOT EXISTS (SELECT 1 FROM v_site t WHERE t.site_id % 97 = 0 AND t.lon = s.lon AND t.lat = s.lat)"))
def obstacle_sites(spark, d):
    """Tall sites that stand at no task's place."""
    rows = sites(spark, d)
    return rows.filter("site_id % 50 > 30").join(rows.filter("site_id % 97 = 0").select("lon", "lat"), ["lon", "lat"], "left_anti").select("site_id")


@query("ordered_predictions", with_demand(f"SELECT label, string_agg(CAST(demand_id AS VARCHAR), ',' ORDER BY coalesce(predicted, 99), coalesce(rank, 99), demand_id) AS ids FROM ({_PREDICTED}) GROUP BY label", 60))
def ordered_predictions(spark, d):
    """A window's predictions in order; a missing priority or rank counts 99."""
    rows = predictions(lens.demands(spark, d, 60))
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce("predicted", F.lit(99)), F.coalesce("rank", F.lit(99)), F.col("demand_id").alias("id"))))
    return rows.groupBy("label").agg(F.array_join(F.transform(listed, lambda s: s["id"].cast("string")), ",").alias("ids"))


@query("rank_contiguity", with_demand(f"SELECT label, coalesce(count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*), false) AS contiguous, count(*) AS n FROM ({_PREDICTED}) GROUP BY label"))
def rank_contiguity(spark, d):
    """Are a window's ranks 1 to n, each once?"""
    n = F.count(F.lit(1))
    fine = (n == F.count_distinct("rank")) & (F.min("rank") == 1) & (F.max("rank") == n)
    return predictions(lens.demands(spark, d)).groupBy("label").agg(F.coalesce(fine, F.lit(False)).alias("contiguous"), n.alias("n"))


@query("demand_cards", with_demand("SELECT label, demand_id, i FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY priority, CASE WHEN cargo IN ('food', 'otc_drug') THEN 1 ELSE 0 END, CASE WHEN destination = 'residential_area' THEN 0 ELSE 1 END, demand_id) AS i FROM v_demand) WHERE i <= 5", 60))
def demand_cards(spark, d):
    """A window's five first cards: by priority, medical goods, quiet places, id."""
    rows = lens.demands(spark, d, 60).withColumns({"goods": F.col("cargo").isin("food", "otc_drug").cast("int"), "loud": (F.col("destination") != "residential_area").cast("int")})
    return ranking.ranked(rows, ["label"], ("priority", "goods", "loud", "demand_id"), "i").filter("i <= 5").select("label", "demand_id", F.col("i").cast("long").alias("i"))


@query("candidate_cards", with_candidate("""SELECT grp, solution_id, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN i <= 3 AND (i < 3 OR gold_at <= 3) THEN i WHEN is_gold AND gold_at > 3 THEN 3 END) AS place FROM (
  SELECT *, max(CASE WHEN is_gold THEN i END) OVER (PARTITION BY grp) AS gold_at FROM (SELECT solution_id % 7 AS grp, solution_id, solution_id = max(solution_id) OVER (PARTITION BY solution_id % 7) AS is_gold,
  row_number() OVER (PARTITION BY solution_id % 7 ORDER BY service_loss, delivery_time, distance, noise, solution_id) AS i FROM v_candidate))
  WHERE i < 3 OR (i = 3 AND gold_at <= 3) OR (is_gold AND gold_at > 3))"""))
def candidate_cards(spark, d):
    """Each group's three best candidates; the one that was chosen takes the last place if it isn't among them."""
    rows = candidates(spark, d).withColumn("grp", F.col("solution_id") % 7)
    own = Window.partitionBy("grp")
    rows = ranking.ranked(rows, ["grp"], ("service_loss", "delivery_time", "distance", "noise", "solution_id"), "i").withColumn("gold", F.col("solution_id") == F.max("solution_id").over(own))
    rows = rows.withColumn("gold_at", F.max(F.when(F.col("gold"), F.col("i"))).over(own))
    kept = rows.filter((F.col("i") < 3) | ((F.col("i") == 3) & (F.col("gold_at") <= 3)) | (F.col("gold") & (F.col("gold_at") > 3)))
    return kept.select("grp", "solution_id", F.least("i", F.lit(3)).cast("long").alias("place"))


@query("first_known", with_demand("SELECT tier, arg_min(demand_id, (ts, demand_id)) FILTER (k % 3 = 0) AS summary, count(*) FILTER (k % 3 = 0) AS n FROM v_demand GROUP BY tier"))
def first_known(spark, d):
    """The first window's record that isn't empty."""
    there = F.when(F.col("k") % 3 == 0, F.struct("ts", "demand_id"))
    return lens.demands(spark, d).groupBy("tier").agg(F.min(there)["demand_id"].alias("summary"), F.count_if(F.col("k") % 3 == 0).alias("n"))


@query("keyword_sets", with_demand("SELECT demand_id, CASE WHEN lower(cargo) = lower(role) THEN lower(cargo) ELSE lower(cargo) || ',' || lower(role) END AS words FROM v_demand"))
def keyword_sets(spark, d):
    """Distinct keywords in the order in which they come."""
    given = F.array("cargo", F.upper("cargo"), "role", "cargo")
    return lens.demands(spark, d).select("demand_id", F.array_join(F.array_distinct(F.transform(given, F.lower)), ",").alias("words"))


@query("sampled_slots", with_demand("SELECT slot FROM (SELECT DISTINCT slot FROM v_demand) ORDER BY (slot * 48271 + 42) % 2147483647, slot LIMIT 12"))
def sampled_slots(spark, d):
    """Twelve slots by hash order: a sampling operator."""
    return lens.demands(spark, d).select("slot").distinct().orderBy((F.col("slot").cast("long") * 48271 + 42) % 2147483647, "slot").limit(12)


@query("methods_as_columns", with_fact("SELECT metric, " + ", ".join(f"max(v) FILTER (method = '{m}') AS {m.lower()}" for m in "ANR") + f" FROM (SELECT method, unnest(['service', 'latency']) AS metric, unnest([{q('avg(CASE WHEN served THEN 1.0 ELSE 0.0 END)')}, {q('avg(latency)')}]) AS v FROM v_fact GROUP BY method) GROUP BY metric"))
def methods_as_columns(spark, d):
    """A report's table: a row a measure, a column a method."""
    means = facts(spark, d).groupBy("method").agg(q6(F.avg(F.col("served").cast("double"))).alias("service"), q6(F.avg("latency")).alias("latency"))
    long = means.unpivot("method", ["service", "latency"], "metric", "v")
    return long.groupBy("metric").pivot("method", list("ANR")).agg(F.max("v")).select("metric", *(F.col(m).alias(m.lower()) for m in "ANR"))


_OWN = ", ".join(f"coalesce(({o} - min({o}) OVER (PARTITION BY b)) / nullif(max({o}) OVER (PARTITION BY b) - min({o}) OVER (PARTITION BY b), 0), 0) AS {o}" for o in OBJECTIVES)


@query("backend_representatives", with_candidate(f"SELECT b, solution_id, i = 1 AS representative FROM (SELECT b, solution_id, row_number() OVER (PARTITION BY b ORDER BY {q(' + '.join(OBJECTIVES))}, CAST(solution_id AS VARCHAR)) AS i FROM (SELECT solution_id, b, {_OWN} FROM (SELECT *, solution_id % 4 AS b FROM v_candidate)))"))
def backend_representatives(spark, d):
    """All backends' candidates in one table, with each backend's representative marked."""
    rows = candidates(spark, d).withColumn("b", F.col("solution_id") % 4)
    w = Window.partitionBy("b")
    scaled = [F.coalesce(ratio(F.col(o) - F.min(o).over(w), F.max(o).over(w) - F.min(o).over(w)), F.lit(0.0)) for o in OBJECTIVES]
    rows = rows.withColumn("s", q6(sum(scaled[1:], scaled[0])))
    return rows.select("b", "solution_id", (F.row_number().over(w.orderBy("s", F.col("solution_id").cast("string"))) == 1).alias("representative"))


@query("supply_points", with_site("SELECT land, site_id, i FROM (SELECT CASE site_id % 3 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'residential' ELSE 'commercial' END AS land, site_id, row_number() OVER (PARTITION BY site_id % 3 ORDER BY site_id) AS i FROM v_site) WHERE i <= 20"))
def supply_points(spark, d):
    """The first twenty sites of each land use."""
    land = F.when(F.col("site_id") % 3 == 0, "healthcare").when(F.col("site_id") % 3 == 1, "residential").otherwise("commercial")
    return ranking.ranked(sites(spark, d).withColumn("land", land), ["land"], ("site_id",), "i").filter("i <= 20").select("land", "site_id", F.col("i").cast("long").alias("i"))


@query("seed_priorities", with_demand("SELECT label, demand_id, k % 4 + 1 AS priority, CAST(row_number() OVER (PARTITION BY label ORDER BY k % 4, demand_id) AS BIGINT) AS window_rank FROM v_demand"))
def seed_priorities(spark, d):
    """A baseline's windows: demands by their seed priority and id."""
    rows = lens.demands(spark, d).withColumn("seed", F.col("k") % 4 + 1)
    return ranking.ranked(rows, ["label"], ("seed", "demand_id")).select("label", "demand_id", F.col("seed").alias("priority"), F.col("window_rank").cast("long").alias("window_rank"))


@query("seed_rollup", with_fact(f"SELECT method, count(DISTINCT seed) AS seeds, {q('avg(v)')} AS mean_latency, count(*) FILTER (v > 500) AS slow, count(*) FILTER (v <= 500) AS fast FROM (SELECT method, carrier % 5 AS seed, month, avg(latency) AS v FROM v_fact GROUP BY ALL) GROUP BY method"))
def seed_rollup(spark, d):
    """Runs of several seeds by method: mean, distinct seeds, verdicts."""
    runs = facts(spark, d).groupBy("method", (F.col("carrier") % 5).alias("seed"), "month").agg(F.avg("latency").alias("v"))
    return runs.groupBy("method").agg(F.count_distinct("seed").alias("seeds"), q6(F.avg("v")).alias("mean_latency"), F.count_if(F.col("v") > 500).alias("slow"), F.count_if(F.col("v") <= 500).alias("fast"))


@query("mixed_means", with_demand(f"SELECT demand_id, {q('(coalesce(a, 0) + coalesce(b, 0) + c) / (1.0 + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END)')} AS core_mean FROM (SELECT demand_id, deadline::DOUBLE AS a, CASE WHEN k % 3 = 0 THEN score::DOUBLE END AS b, priority::DOUBLE AS c FROM v_demand)"))
def mixed_means(spark, d):
    """A row's mean over the values that it has."""
    there = F.array_compact(F.array(F.col("deadline").cast("double"), F.when(F.col("k") % 3 == 0, F.col("score").cast("double")), F.col("priority").cast("double")))
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + x)
    return lens.demands(spark, d).select("demand_id", q6(ratio(total, F.size(there))).alias("core_mean"))


@query("chunk_merge", with_demand(f"SELECT label, {q('avg(w)')} AS w_time, string_agg(ids, ',' ORDER BY chunk) AS ids, count(*) AS chunks FROM (SELECT label, chunk, 1.0 + chunk / 2.0 AS w, string_agg(CAST(demand_id AS VARCHAR), ',' ORDER BY demand_id) AS ids FROM (SELECT label, demand_id, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY demand_id) - 1) / 4.0) AS INT) AS chunk FROM v_demand) GROUP BY label, chunk) GROUP BY label", 60))
def chunk_merge(spark, d):
    """A window's answers in chunks put together again: means of the weights, configurations in order."""
    rows = ranking.ranked(lens.demands(spark, d, 60), ["label"], ("demand_id",), "i").withColumn("chunk", F.floor((F.col("i") - 1) / 4).cast("int"))
    ids = lambda c: F.sort_array(F.collect_list(c))
    chunks = rows.groupBy("label", "chunk").agg(F.array_join(F.transform(ids("demand_id"), lambda x: x.cast("string")), ",").alias("ids")).withColumn("w", 1.0 + F.col("chunk") / 2)
    return chunks.groupBy("label").agg(q6(F.avg("w")).alias("w_time"), F.array_join(F.transform(ids(F.struct("chunk", "ids")), lambda s: s["ids"]), ",").alias("ids"), F.count(F.lit(1)).alias("chunks"))


_WEIGHTS = {"valid": 0.1, "candidate": 0.1, "grp": 0.2, "solution": 0.45, "reason_f1": 0.1, "scene": 0.05}


@query("selection_reward", with_candidate(f"""SELECT solution_id, {q('(' + ' + '.join(f'coalesce({w} * {c}, 0)' for c, w in _WEIGHTS.items()) + ') / (' + ' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in _WEIGHTS.items()) + ')')} AS reward FROM (
  SELECT solution_id, 1.0::DOUBLE AS valid, CASE WHEN solution_id % 6 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS candidate, CASE WHEN solution_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS grp, CASE WHEN solution_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS solution,
  CASE WHEN solution_id % 5 = 0 THEN NULL WHEN solution_id % 5 = 1 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE / 3 END AS reason_f1, CASE WHEN solution_id % 7 = 0 THEN NULL WHEN solution_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS scene FROM v_candidate)"""))
def selection_reward(spark, d):
    """A chosen plan's reward: valid, one of the candidates, right group, right plan, reasons as sets, scene; parts that
    have no truth are left out of the weights."""
    s = F.col("solution_id")
    truth = F.when(s % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("near"), F.lit("quiet")))
    said = F.when(s % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("quiet")))
    parts = {"valid": F.lit(1.0), "candidate": (s % 6 != 0).cast("double"), "grp": (s % 3 == 0).cast("double"), "solution": (s % 4 == 0).cast("double"),
             "reason_f1": metrics.set_f1(said, truth), "scene": F.when(s % 7 != 0, (s % 2 == 0).cast("double"))}
    return candidates(spark, d).select("solution_id", q6(metrics.weighted_mean(parts, _WEIGHTS)).alias("reward"))


_LENGTHS = "SELECT demand_id, 1 + k % 6 AS nodes FROM v_demand"


@query("path_summary", with_demand(f"SELECT count(*) AS entries, count(*) FILTER (nodes > 1) AS moving, max(nodes) AS most, {q('avg(nodes)')} AS mean FROM ({_LENGTHS})"))
def path_summary(spark, d):
    """Flight paths: how many, how many that move, nodes at most and on average."""
    n = F.size(F.transform(F.sequence(F.lit(0), F.col("k") % 6), lambda i: F.struct(i.alias("x"))))
    rows = lens.demands(spark, d).select(n.alias("nodes"))
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("nodes") > 1).alias("moving"), F.max("nodes").alias("most"), q6(F.avg("nodes")).alias("mean"))




@query("segment_clearance", with_site("""SELECT site_id, hits, CAST(floor(nearest * 1000 + 5e-1) AS BIGINT) AS mm FROM (SELECT site_id, count(*) FILTER (dist <= 50) AS hits, min(dist) AS nearest FROM (
  SELECT site_id, sqrt((ax + t * dx - cx) * (ax + t * dx - cx) + (ay + t * dy - cy) * (ay + t * dy - cy)) AS dist FROM (
  SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((cx - ax) * dx + (cy - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM (
  SELECT site_id, ax, ay, bx - ax AS dx, by_ - ay AS dy, cx, cy FROM (SELECT site_id, CAST(site_id % 1000 AS DOUBLE) AS ax, CAST(site_id * 7 % 1000 AS DOUBLE) AS ay, CAST(site_id * 13 % 1000 AS DOUBLE) AS bx, CAST(site_id * 29 % 1000 AS DOUBLE) AS by_ FROM v_site)
  CROSS JOIN (SELECT CAST(i * 211 % 1000 AS DOUBLE) AS cx, CAST(i * 457 % 1000 AS DOUBLE) AS cy FROM range(8) r(i))))) GROUP BY site_id)"""))
def segment_clearance(spark, d):
    """How near a flight's segment comes to each of eight obstacles: the closest point of the segment counts."""
    x = F.col("site_id")
    rows = sites(spark, d).select("site_id", *((x * m % 1000).cast("double").alias(c) for c, m in (("ax", 1), ("ay", 7), ("bx", 13), ("by", 29))))
    obstacles = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i * 211 % 1000).cast("double").alias("cx"), (i * 457 % 1000).cast("double").alias("cy")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def apart(o):
        along = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((o["cx"] - F.col("ax")) * dx + (o["cy"] - F.col("ay")) * dy) / (dx * dx + dy * dy))))
        ex, ey = F.col("ax") + along * dx - o["cx"], F.col("ay") + along * dy - o["cy"]
        return F.sqrt(ex * ex + ey * ey)

    rows = rows.withColumn("dist", F.transform(obstacles, apart))
    return rows.select("site_id", F.size(F.filter("dist", lambda v: v <= 50)).cast("long").alias("hits"), F.floor(F.array_min("dist") * 1000 + 0.5).alias("mm"))
