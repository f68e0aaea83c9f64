"""Queries that evaluate: alignment by source of truth, extraction by event, release gates, counterfactual edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylot.functions.scalars import q6
from skylot.operators import evaluation
from skylot.plans import audits
from skylot.plans.extraction import _READ, read
from skylot.plans.twins import demand, priority, score
from skylot.plans.twins import q6 as q
from skylot.registry import query
from skylot.sources import lens
from skylot.sources.lens import table

#: Weights are lines of a month, so a demand has several; demands name an event, or a dialogue that does, or neither; some
#: events have no truth, and some demands no observable priority.
_PRED = "CASE WHEN l_quantity <= 12 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 38 THEN 3 END"
_ALIGNED = f"""v_weight AS (SELECT substr(CAST(l_shipdate AS VARCHAR), 1, 7) AS w, l_orderkey AS id, {_PRED} AS p FROM lineitem),
v_said AS (SELECT DISTINCT substr(CAST(l_shipdate AS VARCHAR), 1, 7) AS w, l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F'),
v_demand AS (SELECT w, id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE ' ' END AS event, 'D' || id AS dialogue, CASE WHEN o_totalprice > 100000 THEN least(4, CAST(substr(o_orderpriority, 1, 1) AS INT)) END AS seen,
  CASE WHEN o_custkey % 2 = 0 THEN 1 + o_custkey % 4 END AS fixed FROM v_said JOIN orders ON o_orderkey = id),
v_event AS (SELECT v.*, coalesce(nullif(trim(event), ''), CAST(o_custkey AS VARCHAR)) AS e FROM v_demand v LEFT JOIN (SELECT 'D' || o_orderkey AS d, o_custkey FROM orders WHERE o_orderpriority <> '5-LOW') ON d = dialogue),
v_truth AS (SELECT CAST(c_custkey AS VARCHAR) AS e, 1 + c_nationkey % 4 AS latent FROM customer WHERE c_acctbal > 0)"""


def _alignment(source: str, own: str) -> None:
    sql = f"""WITH {_ALIGNED} SELECT t AS true_priority, p AS pred_priority, count(*) AS n FROM (
  SELECT CAST(coalesce({own}, latent) AS INT) AS t, CAST(coalesce(p, 4) AS INT) AS p FROM v_weight JOIN v_event USING (w, id) LEFT JOIN v_truth USING (e) WHERE e IS NOT NULL) WHERE t IS NOT NULL GROUP BY t, p"""

    @query(f"alignment_{source}", sql)
    def alignment(spark, d):
        line, order = table(spark, d, "lineitem"), table(spark, d, "orders")
        line = line.withColumn("time_window", F.substring(F.col("l_shipdate").cast("string"), 1, 7)).withColumnRenamed("l_orderkey", "demand_id")
        weights = line.select("time_window", "demand_id", F.expr(_PRED).alias("priority"))
        said = line.filter("l_linestatus = 'F'").select("time_window", "demand_id").distinct().join(order, F.col("demand_id") == F.col("o_orderkey"))
        named = F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 > 0), F.col("o_custkey").cast("string")).otherwise(" ")
        dialogue = lambda c: F.concat(F.lit("D"), F.col(c).cast("string"))
        demands = said.select("time_window", "demand_id", named.alias("source_event_id"), dialogue("demand_id").alias("source_dialogue_id"),
                              F.when(F.col("o_totalprice") > 100000, F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int"))).alias("observable"))
        fixed = said.select("time_window", "demand_id", F.when(F.col("o_custkey") % 2 == 0, (1 + F.col("o_custkey") % 4).cast("int")).alias("observable"))
        dialogues = order.filter("o_orderpriority <> '5-LOW'").select(dialogue("o_orderkey").alias("dialogue_id"), F.col("o_custkey").alias("event_id"))
        truth = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("event_id"), (1 + F.col("c_nationkey") % 4).alias("latent"))
        return evaluation.aligned(weights, demands, dialogues, truth, source, fixed).groupBy("true_priority", "pred_priority").agg(F.count(F.lit(1)).alias("n"))


for _source, _own in (("auto", "seen"), ("run_extracted", "seen"), ("fixed_demands", "fixed"), ("ground_truth_manifest", "NULL")):
    _alignment(_source, _own)


@query("event_extraction", f"""WITH v_truth AS (SELECT o_orderkey AS e, min(l_suppkey) AS origin, min(o_custkey) AS destination, CAST(max(l_quantity) AS DOUBLE) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey),
v_asked AS (SELECT 'D' || o_orderkey AS dialogue, o_orderkey AS e FROM orders SEMI JOIN v_truth ON e = o_orderkey WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3')),
v_said AS (SELECT (l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_tax) AS place, CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS named, CASE WHEN l_returnflag = 'A' THEN 'D' || l_orderkey ELSE 'none' END AS dialogue, l_suppkey AS origin, o_custkey AS destination, CAST(l_quantity AS DOUBLE) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v_event AS (SELECT s.*, coalesce(named, a.e) AS e FROM v_said s LEFT JOIN v_asked a USING (dialogue)),
v_match AS (SELECT v.*, t.origin AS o, t.destination AS d, t.weight AS w, CASE WHEN v.e IS NULL THEN 'unresolved' WHEN a.e IS NULL THEN 'out_of_scope' WHEN row_number() OVER (PARTITION BY v.e ORDER BY place) = 1 THEN 'tp' ELSE 'duplicate' END AS match
  FROM v_event v LEFT JOIN v_asked a ON a.e = v.e LEFT JOIN v_truth t ON t.e = v.e),
v_sum AS (SELECT count(*) FILTER (match = 'tp') AS tp, count(*) FILTER (match <> 'tp') AS fp, count(*) FILTER (match = 'duplicate') AS duplicates, count(*) FILTER (match = 'unresolved') AS unresolved, count(*) FILTER (match = 'out_of_scope') AS out_of_scope, (SELECT count(DISTINCT e) FROM v_asked) AS n_true,
  count(*) FILTER (match = 'tp' AND origin = o) AS a, count(*) FILTER (match = 'tp' AND destination = d) AS b, count(*) FILTER (match = 'tp' AND abs(weight - w) <= 1e-6) AS c, count(*) FILTER (match = 'tp' AND origin = o AND destination = d AND abs(weight - w) <= 1e-6) AS x FROM v_match)
SELECT n_true, tp, fp, n_true - tp AS fn, duplicates, unresolved, out_of_scope, {q('tp / (tp + fp)::DOUBLE')} AS precision, {q('tp / n_true::DOUBLE')} AS recall, {q('2 * tp / (2 * tp + fp + n_true - tp)::DOUBLE')} AS f1,
  {q('x / tp::DOUBLE')} AS exact_rate, {q('a / tp::DOUBLE')} AS origin_rate, {q('b / tp::DOUBLE')} AS destination_rate, {q('c / tp::DOUBLE')} AS weight_rate FROM v_sum""")
def event_extraction(spark, d):
    """Lines as demands extracted from the dialogues of orders: some name their event, some only the dialogue, some neither."""
    line, order = table(spark, d, "lineitem"), table(spark, d, "orders")
    dialogue = F.concat(F.lit("D"), F.col("o_orderkey").cast("string"))
    both = line.join(order, line["l_orderkey"] == order["o_orderkey"])
    truth = both.filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderkey").alias("event_id")).agg(F.min("l_suppkey").alias("origin"), F.min("o_custkey").alias("destination"), F.max("l_quantity").cast("double").alias("weight"))
    dialogues = order.select(dialogue.alias("dialogue_id"), F.col("o_orderkey").alias("event_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("slot"))
    said = both.select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_tax").alias("place"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("source_event_id"),
                       F.when(F.col("l_returnflag") == "A", dialogue).otherwise("none").alias("source_dialogue_id"), F.col("l_suppkey").alias("origin"), F.col("o_custkey").alias("destination"), F.col("l_quantity").cast("double").alias("weight"))
    row = evaluation.extraction_summary(evaluation.matched(said, dialogues, truth, [1, 2, 3]))
    return row.withColumns({c: q6(F.col(c)) for c in row.columns if c in ("precision", "recall", "f1") or c.endswith("_rate")})


_HARD = "concat('w', CAST(demand_id AS STRING), '::', CASE k % 5 WHEN 0 THEN 'counterfactual_1' WHEN 1 THEN 'surface_contradiction_1' WHEN 2 THEN 'near_tie' WHEN 3 THEN 'mixed_priority' ELSE 'plain' END)"
_GATES = f"""{audits._FACTORS},
v_mask AS (SELECT demand_id, tier, cargo, destination, priority AS whole, {audits._MISSING} AS missing, need_scenario_context, seen_scenario_context, {', '.join(f'{e} AS {c}' for c, e in audits._MASK.items())} FROM v_seen),
v_judged AS (SELECT *, {score()} AS score FROM v_mask), v_verdict AS (SELECT *, missing = '' AND {priority()} = whole AS ok FROM v_judged),
v_a AS (SELECT count(*) FILTER (ok) / count(*)::DOUBLE AS whole_rate, {', '.join(f'round(count(*) FILTER (ok AND whole = {i}) / nullif(count(*) FILTER (whole = {i}), 0)::DOUBLE, 4) AS r{i}' for i in (1, 2, 4))},
  count(*) FILTER (need_scenario_context AND NOT seen_scenario_context) / count(*) FILTER (need_scenario_context)::DOUBLE AS lost FROM v_verdict),
v_b AS (SELECT round(count(*) FILTER (x_role = '') / count(*)::DOUBLE, 4) AS silent, round(count(*) FILTER (x_role = role) / count(*)::DOUBLE, 4) AS same FROM {_READ}),
v_c AS (SELECT count(*) FILTER (k % 5 = 1) AS c, count(*) FILTER (k % 5 = 2) AS t, count(*) AS n FROM v_demand),
v_value AS (SELECT unnest([{', '.join(f"'{g}'" for g in evaluation.GATES)}]) AS gate, unnest([{', '.join('NULL' if lo is None else f'{lo}::DOUBLE' for lo, _ in evaluation.GATES.values())}]) AS low, unnest([{', '.join('NULL' if hi is None else f'{hi}::DOUBLE' for _, hi in evaluation.GATES.values())}]) AS high,
  unnest([whole_rate, r1, r2, CASE WHEN r4 IS NOT NULL AND coalesce(r1, r2) IS NOT NULL THEN greatest(coalesce(r4 - r1, 0), coalesce(r4 - r2, 0), 0) END, lost, silent, same, round(c / n::DOUBLE, 4), round(t / n::DOUBLE, 4), c::DOUBLE, t::DOUBLE]) AS value FROM v_a, v_b, v_c),
v_gate AS (SELECT gate, round(value, 4) AS value, low, high, value IS NULL AS skipped, coalesce(value >= low, true) AND coalesce(value <= high, true) AS passed FROM v_value)"""


def _checks(spark, d):
    rows = audits.masked(spark, d)
    dialogues = lens.scored(rows).select(F.col("whole").alias("priority"), ((F.size("missing") == 0) & (F.col("priority") == F.col("whole"))).alias("passed"), "needed", "missing")
    roles = read(spark, d).select(F.col("role").alias("expected"), F.col("x_role").alias("observed"))
    return evaluation.gate_checks(dialogues, roles, lens.demands(spark, d).select(F.expr(_HARD).alias("name")))


@query("quality_gates", f"WITH {_GATES} SELECT * FROM v_gate")
def quality_gates(spark, d):
    """The eleven gates of a shard: audits, roles and hard cases against their limits."""
    return _checks(spark, d)


@query("release_manifest", f"""WITH {_GATES}, v_ready AS (SELECT bool_and(passed) FILTER (gate IN ({', '.join(f"'{g}'" for g in evaluation.PIPELINE)})) AS p, bool_and(passed) FILTER (gate IN ({', '.join(f"'{g}'" for g in evaluation.RANKING)})) AS r,
  coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), '') AS failed, (SELECT count(*) > 0 FROM v_demand) AS clean FROM v_gate)
SELECT CASE WHEN NOT clean THEN 'debug_only' WHEN p AND r THEN 'accepted' ELSE 'needs_regen' END AS status, concat_ws(',', CASE WHEN clean THEN 'llm3_sft_clean' END, CASE WHEN p THEN 'llm2_sft' END, CASE WHEN p THEN 'llm3_sft_pipeline' END, CASE WHEN p AND r THEN 'llm3_grpo_hard' END) AS files, failed FROM v_ready""")
def release_manifest(spark, d):
    """Which of a shard's files may be trained on, and which gates failed."""
    return evaluation.release(_checks(spark, d), lens.demands(spark, d))


_EDITS = {"deadline15": ("coalesce(nullif(deadline, 0), 120) > 15", {"deadline": "15", "hard": "true"}), "emergency_role": ("role <> 'emergency_doctor'", {"role": "'emergency_doctor'"}),
          "cold_chain": ("handling IS DISTINCT FROM 'cold_chain'", {"handling": "coalesce(handling, 'cold_chain')"}), "not_ready": ("ready", {"ready": "false"}),
          "vulnerable": ("NOT vulnerable", {c: "true" for c in ("vulnerable", "children", "elderly")}), "clinic": ("destination NOT IN ('hospital', 'clinic', 'community_health_center')", {"destination": "'clinic'"})}


@query("counterfactual_variants", f"""WITH {demand()}, v_edit AS ({' UNION ALL '.join(f"SELECT * EXCLUDE (score, solver_score, priority) REPLACE ({', '.join(f'{v} AS {c}' for c, v in sets.items())}), '{n}' AS variant FROM v_demand WHERE {test}" for n, (test, sets) in _EDITS.items())}),
v_again AS (SELECT *, {score()} AS score FROM v_edit)
SELECT demand_id || '_cf_' || variant AS variant_id, score AS new_score, score + CASE WHEN ready THEN 6 ELSE 0 END + 2 AS new_solver_score, {priority()} AS new_priority FROM v_again""")
def counterfactual_variants(spark, d):
    """Six edits of one field each, where they change something, scored anew by the rules."""
    rows = lens.scored(evaluation.edited(lens.demands(spark, d)))
    return rows.select(F.concat_ws("_cf_", F.col("demand_id").cast("string"), "variant").alias("variant_id"), F.col("score").alias("new_score"), F.col("solver_score").alias("new_solver_score"), F.col("priority").alias("new_priority"))
