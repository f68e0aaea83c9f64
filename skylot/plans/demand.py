"""Queries over demands and their time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.functions import rules
from skylot.functions.scalars import q6
from skylot.operators import ranking
from skylot.operators.ranking import RANK_LABEL, RANK_RULE
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_demand
from skylot.registry import query
from skylot.sources import lens

_RANK = "SELECT label, demand_id, tier, score, priority, CAST(row_number() OVER (PARTITION BY label ORDER BY {}) AS BIGINT) AS window_rank FROM v_demand"


def _ranked(spark: SparkSession, d: str, by: tuple[str, ...]) -> DataFrame:
    return ranking.ranked(lens.demands(spark, d), ["label"], by).select(
        "label", "demand_id", "tier", "score", "priority", F.col("window_rank").cast("long").alias("window_rank"))


@query("window_rank", with_demand(_RANK.format("priority, score DESC, demand_id")))
def window_rank(spark, d):
    return _ranked(spark, d, RANK_LABEL)


@query("window_rank_rule", with_demand(_RANK.format("score DESC, priority, demand_id")))
def window_rank_rule(spark, d):
    return _ranked(spark, d, RANK_RULE)


@query("uniform_rank", with_demand("SELECT label, demand_id, 2 AS priority, CAST(row_number() OVER (PARTITION BY label ORDER BY demand_id) AS BIGINT) AS window_rank FROM v_demand"))
def uniform_rank(spark, d):
    rows = ranking.ranked(lens.demands(spark, d), ["label"], ("demand_id",))
    return rows.select("label", "demand_id", F.lit(2).alias("priority"), F.col("window_rank").cast("long").alias("window_rank"))


@query("hashed_rank", with_demand("SELECT label, demand_id, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(CAST(demand_id AS VARCHAR) || ':42'), demand_id) AS BIGINT) AS window_rank FROM v_demand"))
def hashed_rank(spark, d):
    """The random baseline, by hash order."""
    rows = lens.demands(spark, d).withColumn("h", F.md5(F.concat(F.col("demand_id").cast("string"), F.lit(":42")).cast("binary")))
    return ranking.ranked(rows, ["label"], ("h", "demand_id")).select("label", "demand_id", F.col("window_rank").cast("long").alias("window_rank"))


def _counts(width: int):
    sql = with_demand("SELECT label, count(*) AS n, min(priority) AS lowest, max(priority) AS highest FROM v_demand GROUP BY label", width)

    @query(f"window_counts_{width}m", sql)
    def window_counts(spark, d):
        return lens.demands(spark, d, width).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("lowest"), F.max("priority").alias("highest"))


for _width in (5, 60, 7):
    _counts(_width)


@query("tier_distribution", with_demand("SELECT tier, priority, count(*) AS n FROM v_demand GROUP BY tier, priority"))
def tier_distribution(spark, d):
    return lens.demands(spark, d).groupBy("tier", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("reason_codes", with_demand(f"""SELECT demand_id, concat_ws(',', 'tier=' || tier,
  CASE WHEN coalesce(deadline, 0) BETWEEN 1 AND 15 THEN 'deadline<=15m' WHEN coalesce(deadline, 0) BETWEEN 1 AND 30 THEN 'deadline<=30m' WHEN coalesce(deadline, 0) BETWEEN 1 AND 60 THEN 'deadline<=60m' END,
  CASE WHEN hard THEN 'hard_deadline' END, CASE WHEN cargo IN ('aed', 'blood_product', 'ventilator', 'icu_drug') THEN 'cargo=' || cargo END,
  CASE WHEN contains(text, 'cardiac arrest') THEN 'life_threatening_context' WHEN contains(text, 'icu') OR contains(text, 'post-exposure') THEN 'critical_clinical_context' END,
  CASE WHEN role IN ('emergency_doctor', 'paramedic', 'icu_nurse', 'ward_coordinator') THEN 'role=' || role END,
  CASE WHEN children THEN 'children_involved' END, CASE WHEN elderly THEN 'elderly_involved' END, CASE WHEN vulnerable THEN 'vulnerable_community' END,
  CASE WHEN contains(text, 'standing by') THEN 'handoff_ready' END, CASE WHEN handling IS NOT NULL THEN 'special_handling' END,
  CASE WHEN destination IN ('hospital', 'clinic') AND tier IN ('life_support', 'critical') THEN 'destination=' || destination END) AS codes FROM v_demand"""))
def reason_codes(spark, d):
    return lens.demands(spark, d).select("demand_id", F.array_join("reasons", ",").alias("codes"))


@query("priority_score_range", with_demand("""SELECT priority, count(*) AS n, min(score) AS low, max(score) AS high, sum(CASE WHEN hard THEN 1 ELSE 0 END)::BIGINT AS hard FROM v_demand GROUP BY priority"""))
def priority_score_range(spark, d):
    return lens.demands(spark, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_if("hard").alias("hard"))


@query("factor_hits", with_demand("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN hard THEN 'hard_deadline' END, CASE WHEN children THEN 'children_involved' END, CASE WHEN elderly THEN 'elderly_involved' END,
  CASE WHEN vulnerable THEN 'vulnerable_community' END, CASE WHEN contains(text, 'standing by') THEN 'handoff_ready' END,
  CASE WHEN handling IS NOT NULL THEN 'special_handling' END], lambda x: x IS NOT NULL)) AS code FROM v_demand) GROUP BY code"""))
def factor_hits(spark, d):
    """How often each rule without a value of its own holds."""
    hits = lens.demands(spark, d).select(F.explode("reasons").alias("code"))
    return hits.filter(~F.col("code").contains("=") & ~F.col("code").contains("context")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("solver_mode_delta", with_demand("SELECT demand_id, score, solver_score, solver_score - score AS delta FROM v_demand"))
def solver_mode_delta(spark, d):
    return lens.demands(spark, d).select("demand_id", "score", "solver_score", (F.col("solver_score") - F.col("score")).alias("delta"))


@query("pairwise_prefs", with_demand("SELECT a.label, a.demand_id AS higher_id, b.demand_id AS lower_id, b.priority - a.priority AS gap FROM v_demand a JOIN v_demand b ON a.label = b.label AND a.priority < b.priority"))
def pairwise_prefs(spark, d):
    return ranking.preferences(lens.demands(spark, d), ["label"])


@query("pref_counts", with_demand(f"SELECT a.label, count(*) AS n_pairs, {q('avg(b.priority - a.priority)')} AS avg_gap FROM v_demand a JOIN v_demand b ON a.label = b.label AND a.priority < b.priority GROUP BY a.label"))
def pref_counts(spark, d):
    return ranking.preference_counts(lens.demands(spark, d), ["label"]).withColumn("avg_gap", q6(F.col("avg_gap")))


@query("urgent_topk_targets", with_demand("""SELECT label, string_agg(CAST(demand_id AS VARCHAR), ',' ORDER BY place) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY priority, score DESC, demand_id) AS place FROM v_demand) WHERE place <= 3 AND priority <= 2 GROUP BY label"""))
def urgent_topk_targets(spark, d):
    top = ranking.ranked(lens.demands(spark, d), ["label"], RANK_LABEL, "place").filter("place <= 3 AND priority <= 2")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "demand_id"))), lambda s: s["demand_id"].cast("string"))
    return top.groupBy("label").agg(F.array_join(ids, ",").alias("ids"))


@query("feasible_split", with_demand("SELECT label, count(*) AS n_total, count(*) FILTER (weight_kg <= 60) AS n_feasible, count(*) FILTER (NOT coalesce(weight_kg <= 60, false)) AS n_rejected FROM v_demand GROUP BY label"))
def feasible_split(spark, d):
    fits = F.coalesce(F.col("weight_kg") <= 60, F.lit(False))
    return lens.demands(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(fits).alias("n_feasible"), F.count_if(~fits).alias("n_rejected"))


@query("slot_filter", with_demand("SELECT demand_id, slot, label FROM v_demand WHERE slot IN (0, 1, 12, 100, 287)"))
def slot_filter(spark, d):
    return lens.demands(spark, d).filter(F.col("slot").isin(0, 1, 12, 100, 287)).select("demand_id", "slot", "label")


@query("style_expansion", with_demand("SELECT demand_id, style FROM v_demand CROSS JOIN (SELECT unnest(['direct', 'technical', 'emotional', 'terse']) AS style)"))
def style_expansion(spark, d):
    styles = F.array(*map(F.lit, ("direct", "technical", "emotional", "terse")))
    return lens.demands(spark, d).select("demand_id", F.explode(styles).alias("style"))


@query("batch_of_k", with_demand("SELECT label, batch_no, count(*) AS n FROM (SELECT label, CAST(FLOOR((row_number() OVER (PARTITION BY label ORDER BY demand_id) - 1) / 3.0) AS INT) AS batch_no FROM v_demand) GROUP BY label, batch_no", 60))
def batch_of_k(spark, d):
    rows = ranking.ranked(lens.demands(spark, d, 60), ["label"], ("demand_id",), "place")
    return rows.groupBy("label", F.floor((F.col("place") - 1) / 3).cast("int").alias("batch_no")).agg(F.count(F.lit(1)).alias("n"))


@query("train_val_split", with_demand("SELECT demand_id, CASE WHEN (demand_id * 48271 + 42) % 2147483647 % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM v_demand"))
def train_val_split(spark, d):
    """A split by hash: the same for any partitioning, no order over all rows needed."""
    h = (F.col("demand_id") * 48271 + 42) % 2147483647
    return lens.demands(spark, d).select("demand_id", F.when(h % 10 == 0, "val").otherwise("train").alias("split"))


@query("oversample", with_demand("SELECT demand_id, unnest(range(1, CASE WHEN priority = 1 THEN 4 ELSE 2 END))::INT AS copy_no FROM v_demand"))
def oversample(spark, d):
    n = F.when(F.col("priority") == 1, 3).otherwise(1)
    return lens.demands(spark, d).select("demand_id", F.explode(F.sequence(F.lit(1), n)).alias("copy_no"))


@query("stratum_flags", with_demand("SELECT label, bool_or(priority = 1) AS has_p1, bool_or(priority = 2) AS has_p2, bool_or(vulnerable) AS has_vulnerable, count(DISTINCT priority) AS n_labels, count(*) AS n FROM v_demand GROUP BY label", 60))
def stratum_flags(spark, d):
    c = F.col
    return lens.demands(spark, d, 60).groupBy("label").agg(F.bool_or(c("priority") == 1).alias("has_p1"), F.bool_or(c("priority") == 2).alias("has_p2"),
                                                          F.bool_or("vulnerable").alias("has_vulnerable"), F.count_distinct("priority").alias("n_labels"), F.count(F.lit(1)).alias("n"))


@query("stratified_sample", with_demand("""SELECT stratum, label FROM (SELECT p AS stratum, label, row_number() OVER (PARTITION BY p ORDER BY n_labels DESC, n DESC, label) AS place FROM (
  SELECT label, count(DISTINCT priority) AS n_labels, count(*) AS n, unnest(list(DISTINCT priority)) AS p FROM v_demand GROUP BY label)) WHERE place = 1""", 60))
def stratified_sample(spark, d):
    """For each priority the window with the most priorities, then the most demands."""
    windows = lens.demands(spark, d, 60).groupBy("label").agg(F.collect_set("priority").alias("there"), F.count(F.lit(1)).alias("n"))
    rows = windows.withColumn("n_labels", F.size("there")).withColumn("stratum", F.explode("there"))
    return ranking.first_wins(rows, ["stratum"], ("-n_labels", "-n", "label")).select("stratum", "label")


@query("label_roundtrip", with_demand("""SELECT DISTINCT label, substr(label, 1, 10) || ' ' || substr(label, 12, 5) AS start_at,
  CASE WHEN substr(label, 18, 5) = '24:00' THEN CAST(CAST(substr(label, 1, 10) AS DATE) + 1 AS VARCHAR) || ' 00:00' ELSE substr(label, 1, 10) || ' ' || substr(label, 18, 5) END AS end_at
  FROM (SELECT split_part(label || '::technical', '::', 1) AS label FROM v_demand)"""))
def label_roundtrip(spark, d):
    """Labels, with a style suffix that is taken off, back to bounds; 24:00 is the next day."""
    rows = lens.demands(spark, d).select(F.split_part(F.concat("label", F.lit("::technical")), F.lit("::"), F.lit(1)).alias("label")).distinct()
    day, stop = F.substring("label", 1, 10), F.substring("label", 18, 5)
    end = F.when(stop == "24:00", F.concat(F.date_add(day.cast("date"), 1).cast("string"), F.lit(" 00:00"))).otherwise(F.concat(day, F.lit(" "), stop))
    return rows.select("label", F.concat(day, F.lit(" "), F.substring("label", 12, 5)).alias("start_at"), end.alias("end_at"))


@query("subtype_split", with_demand("""SELECT subset, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v_demand) AS ratio FROM (SELECT CASE WHEN contains(name, 'counterfactual') THEN 'counterfactual'
  WHEN contains(name, 'contradiction') THEN 'surface_contradiction' WHEN contains(name, 'near_tie') THEN 'near_tie' WHEN contains(name, 'mixed') THEN 'mixed_priority' ELSE 'other' END AS subset
  FROM (SELECT label || '::' || CASE k % 5 WHEN 0 THEN 'counterfactual_1' WHEN 1 THEN 'surface_contradiction_1' WHEN 2 THEN 'near_tie' WHEN 3 THEN 'mixed_priority' ELSE 'plain' END AS name FROM v_demand)) GROUP BY subset"""))
def subtype_split(spark, d):
    kinds = ("counterfactual_1", "surface_contradiction_1", "near_tie", "mixed_priority", "plain")
    name = F.concat("label", F.lit("::"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % 5 + 1).cast("int")))
    has = name.contains
    subset = F.when(has("counterfactual"), "counterfactual").when(has("contradiction"), "surface_contradiction").when(has("near_tie"), "near_tie").when(has("mixed"), "mixed_priority").otherwise("other")
    counts = lens.demands(spark, d).groupBy(subset.alias("subset")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("subset", "n", (F.col("n").cast("double") / F.col("all")).alias("ratio"))  # total: one row


@query("near_tie_pairs", with_demand("SELECT a.label, a.demand_id AS a, b.demand_id AS b, abs(a.score - b.score) AS gap FROM v_demand a JOIN v_demand b ON a.label = b.label AND a.demand_id < b.demand_id AND a.priority <> b.priority AND abs(a.score - b.score) <= 6", 60))
def near_tie_pairs(spark, d):
    return ranking.near_ties(lens.demands(spark, d, 60), ["label"], 6)


@query("merge_policy", with_demand("""SELECT label, demand_id, rule_priority, llm_priority, merged, blended, CAST(row_number() OVER (PARTITION BY label ORDER BY blended DESC, merged, demand_id) AS BIGINT) AS window_rank FROM (
  SELECT label, demand_id, priority AS rule_priority, m AS llm_priority, CASE WHEN m IS NULL OR priority = 1 OR abs(priority - m) <= 1 THEN priority ELSE m END AS merged,
  (5 - priority) * 20 + coalesce((5 - m) * 8, 0) AS blended FROM (SELECT *, CASE WHEN k % 5 < 4 THEN k % 4 + 1 END AS m FROM v_demand))"""))
def merge_policy(spark, d):
    """Rule and model priorities: the rule's stays if it is 1, if the two are at most 1 apart or if the model has none;
    else the model's counts. The window is ranked anew by a score blended from both."""
    rows = lens.demands(spark, d).withColumn("m", F.when(F.col("k") % 5 < 4, F.col("k") % 4 + 1))
    return ranking.merged(rows, ["label"], "priority", "m").select(
        "label", "demand_id", F.col("priority").alias("rule_priority"), F.col("m").alias("llm_priority"), "merged", "blended", F.col("window_rank").cast("long").alias("window_rank"))


@query("interval_active_window", with_demand("""SELECT demand_id, (hour(ts) * 60 + minute(ts)) // 90 AS active FROM v_demand"""))
def interval_active_window(spark, d):
    """Which of the day's 90-minute weight windows is active at a demand's time: an interval join."""
    schedule = spark.range(16).select(F.col("id").alias("active"), (F.col("id") * 90).alias("start"), (F.col("id") * 90 + 90).alias("stop"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = lens.demands(spark, d).withColumn("m", minute)
    return rows.join(F.broadcast(schedule), (F.col("m") >= F.col("start")) & (F.col("m") < F.col("stop"))).select("demand_id", "active")  # 16 rows


@query("time_of_day", with_demand("SELECT CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS bucket, count(*) AS n FROM v_demand GROUP BY 1"))
def time_of_day(spark, d):
    h = F.hour("ts")
    bucket = F.when(h < 6, "overnight").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    return lens.demands(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("inter_arrival", with_demand("SELECT user_id, demand_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, demand_id), ts) AS gap_s FROM v_demand"))
def inter_arrival(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "demand_id")
    ts = F.col("ts").cast("timestamp")
    gap = F.unix_seconds(F.date_trunc("second", ts)) - F.unix_seconds(F.date_trunc("second", F.lag(ts).over(w)))
    return lens.demands(spark, d).select("user_id", "demand_id", gap.alias("gap_s"))


@query("window_documents", with_demand("SELECT label, count(*) AS n, md5(string_agg(demand_id || ':' || priority, ',' ORDER BY demand_id)) AS body FROM v_demand GROUP BY label", 60))
def window_documents(spark, d):
    """Rows nested back into one document a window."""
    items = F.sort_array(F.collect_list(F.struct("demand_id", "priority")))
    body = F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["demand_id"].cast("string"), s["priority"].cast("string"))), ",")
    return lens.demands(spark, d, 60).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.md5(body.cast("binary")).alias("body"))


_SAID = {"said_tier": "CASE k % 4 WHEN 0 THEN tier WHEN 1 THEN 'vip' END", "cargo_tier": "CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN '' END",
         "urgency": "CASE k % 5 WHEN 0 THEN 'extreme' WHEN 1 THEN 'urgent' WHEN 2 THEN 'express' WHEN 3 THEN 'whenever' END", "said_priority": "CASE k % 6 WHEN 0 THEN '0' WHEN 1 THEN '9' WHEN 2 THEN 'high' WHEN 3 THEN CAST(priority AS STRING) WHEN 4 THEN ' 2 ' END"}


@query("tier_fallbacks", with_demand(f"""SELECT demand_id, CASE WHEN {_SAID['said_tier']} IN ('life_support', 'critical', 'regular', 'consumer') THEN tier WHEN k % 3 = 0 THEN 'critical' WHEN k % 5 = 0 THEN 'life_support' WHEN k % 5 = 1 THEN 'critical' ELSE 'regular' END AS tier,
  CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 3 THEN priority WHEN 4 THEN 2 ELSE 4 END AS priority FROM v_demand"""))
def tier_fallbacks(spark, d):
    """The first that names a tier: the demand, its cargo, its urgency, else regular; and its priority as a whole number from 1 to 4."""
    rows = lens.demands(spark, d).withColumns({c: F.expr(e) for c, e in _SAID.items()})
    return rows.select("demand_id", rules.resolved_tier(F.col("said_tier"), F.col("cargo_tier"), F.col("urgency")).alias("tier"), rules.normalized_priority(F.col("said_priority")).alias("priority"))
