"""The audit of ranking data over windows with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylot.operators import quality, ranking
from skylot.plans.twins import demand
from skylot.registry import query
from skylot.sources import lens

#: Where a demand's key plants a fault: its id, its label, its pair, its target.
_ID = "CASE WHEN k = 97 THEN '' WHEN k = 96 THEN 'DUP' ELSE concat('D', CAST(demand_id AS STRING)) END"
_LABEL_ID, _LABEL_PRIORITY, _LABEL_RANK = "CASE WHEN k = 50 THEN 'ghost' ELSE id END", "CASE WHEN k = 33 THEN 9 ELSE priority END", "CASE WHEN k <> 77 THEN window_rank END"
_HIGH, _GAP = "CASE WHEN k = 61 THEN 'ghost' ELSE id END", "next_priority - priority + CASE WHEN k = 11 THEN 1 ELSE 0 END"
_TARGET = "CASE WHEN k = 88 THEN 'ghost' WHEN priority <= 2 AND k <> 20 THEN id END"


def windows(spark, d):
    """(source, line, value): a day's windows of an hour as JSON lines."""
    rows = ranking.ranked(lens.demands(spark, d, 60), ["label"], ranking.RANK_LABEL).withColumn("id", F.expr(_ID))
    rows = rows.withColumns({c: F.lead(n).over(Window.partitionBy("label").orderBy("window_rank")) for c, n in (("next_id", "id"), ("next_priority", "priority"))})
    labels = F.struct(F.col("priority").alias("extraction_observable_priority"), F.col("score").alias("extraction_observable_score"))
    none = F.lit(None).cast("array<string>")
    handling = F.when(F.col("k") == 94, '"cold"').otherwise("[]")
    signals = F.concat(F.lit('{"special_handling":'), handling, F.lit(',"population_vulnerability":{}}'))
    one = F.concat(F.lit('{"demand_id":"'), "id", F.lit('","labels":'), F.to_json(labels), F.lit(',"context_signals":'), F.when(F.col("k") == 95, "null").otherwise("[]"), F.lit(',"priority_evaluation_signals":'), signals, F.lit("}"))
    keep = {"ignoreNullFields": "false"}
    label = F.to_json(F.struct(F.expr(_LABEL_ID).alias("demand_id"), F.expr(_LABEL_PRIORITY).alias("priority"), F.expr(_LABEL_RANK).alias("window_rank")), keep)
    pair = F.when(F.col("next_priority") != F.col("priority"), F.to_json(F.struct(F.expr(_HIGH).alias("higher_priority_demand_id"), F.col("next_id").alias("lower_priority_demand_id"), F.expr(_GAP).alias("priority_gap"))))
    target = F.concat(F.lit('"'), F.expr(_TARGET), F.lit('"'))
    parts = {"demands": one, "priority_labels": label, "pairwise_preferences": pair, "critical_topk_targets": target}
    each = rows.select("label", F.struct("window_rank", *(F.coalesce(c, none.cast("string")).alias(n) for n, c in parts.items())).alias("p"))
    window = each.groupBy("label").agg(F.sort_array(F.collect_list("p")).alias("p"))
    listed = lambda n: F.concat(F.lit(f'"{n}":['), F.array_join(F.array_compact(F.transform("p", lambda x: x[n])), ","), F.lit("]"))
    text = F.concat(F.lit('{"time_window":"'), "label", F.lit('",'), F.concat_ws(",", *map(listed, parts)), F.lit("}"))
    return window.select(F.substring("label", 1, 10).alias("source"), F.substring("label", 12, 2).cast("long").alias("line"), text.alias("value"))


_V = {n: e.replace("AS STRING", "AS VARCHAR") for n, e in (("id", _ID), ("lid", _LABEL_ID), ("lp", _LABEL_PRIORITY), ("lr", _LABEL_RANK), ("high", _HIGH), ("gap", _GAP), ("target", _TARGET))}


@query("ranking_data_audit", f"""WITH {demand(60)},
v_d AS MATERIALIZED (SELECT *, lead(id) OVER w AS next_id, lead(priority) OVER w AS next_priority FROM (
  SELECT label, demand_id, priority, score, k, {_V['id']} AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY priority, score DESC, demand_id) AS INT) AS window_rank FROM v_demand) WINDOW w AS (PARTITION BY label ORDER BY window_rank)),
v_l AS MATERIALIZED (SELECT label, window_rank AS i, {_V['lid']} AS lid, {_V['lp']} AS lp, {_V['lr']} AS lr FROM v_d),
v_map AS MATERIALIZED (SELECT label, lid AS id, arg_max(lp, i) AS p FROM v_l WHERE lid <> '' GROUP BY label, lid),
v_id AS MATERIALIZED (SELECT DISTINCT label, id FROM v_d WHERE id <> ''),
v_p AS MATERIALIZED (SELECT label, window_rank AS i, {_V['high']} AS high, next_id AS low, {_V['gap']} AS gap FROM v_d WHERE next_priority <> priority),
v_t AS MATERIALIZED (SELECT label, window_rank AS i, {_V['target']} AS t FROM v_d WHERE {_V['target']} IS NOT NULL),
v_want AS MATERIALIZED (SELECT label, id, priority AS p, CAST(row_number() OVER (PARTITION BY label ORDER BY priority, score DESC, id) AS INT) AS i FROM v_d),
v_all AS (SELECT h.label, list((h.id, l.id, l.p - h.p) ORDER BY h.i, l.i) AS x FROM v_want h JOIN v_want l ON h.label = l.label AND h.i < l.i AND h.p <> l.p GROUP BY h.label),
v_known AS (SELECT p.*, a.id IS NOT NULL AND b.id IS NOT NULL AS known, m.p AS hp, n.p AS lp FROM v_p p LEFT JOIN v_id a ON a.label = p.label AND a.id = high LEFT JOIN v_id b ON b.label = p.label AND b.id = low
  LEFT JOIN v_map m ON m.label = p.label AND m.id = high LEFT JOIN v_map n ON n.label = p.label AND n.id = low),
v_w AS (SELECT label, (SELECT list(id ORDER BY id) FROM v_id x WHERE x.label = d.label) AS ids, (SELECT list(id ORDER BY id) FROM v_map x WHERE x.label = d.label) AS named, coalesce((SELECT list(t ORDER BY i) FROM v_t x WHERE x.label = d.label), []) AS targets,
  coalesce((SELECT list(id ORDER BY id) FROM v_map x WHERE x.label = d.label AND p <= 2), []) AS urgent, (SELECT list((lid, lp, lr) ORDER BY i) FROM v_l x WHERE x.label = d.label) AS labels, (SELECT list(lr ORDER BY lr) FROM v_l x WHERE x.label = d.label AND lr IS NOT NULL) AS ranks,
  (SELECT list((id, p, i) ORDER BY i) FROM v_want x WHERE x.label = d.label) AS want, coalesce((SELECT list(id ORDER BY i) FROM v_want x WHERE x.label = d.label AND p <= 2), []) AS top,
  coalesce((SELECT list((high, low, gap) ORDER BY i) FROM v_p x WHERE x.label = d.label), []) AS pairs, coalesce((SELECT x FROM v_all a WHERE a.label = d.label), []) AS every, count(*) FILTER (id <> '') AS n, count(DISTINCT id) FILTER (id <> '') AS m, count(*) AS size FROM v_d d GROUP BY label)
SELECT issue, n FROM (
  SELECT 'missing_demand_id' AS issue, count(*) AS n FROM v_d WHERE id = '' UNION ALL SELECT 'context_signals_none', count(*) FROM v_d WHERE k = 95 UNION ALL SELECT 'special_handling_not_list', count(*) FROM v_d WHERE k = 94
  UNION ALL SELECT 'invalid_priority_value', count(*) FROM v_l WHERE lp = 9 UNION ALL SELECT 'invalid_window_rank', count(*) FROM v_l WHERE lr IS NULL UNION ALL SELECT 'duplicate_demand_id', count(*) FROM v_w WHERE n <> m
  UNION ALL SELECT 'priority_label_id_set_mismatch', count(*) FROM v_w WHERE ids IS DISTINCT FROM named UNION ALL SELECT 'window_ranks_not_contiguous', count(*) FROM v_w WHERE len(ranks) > 0 AND ranks <> range(1, size + 1)
  UNION ALL SELECT 'pairwise_unknown_demand_id', count(*) FROM v_known WHERE NOT known UNION ALL SELECT 'pairwise_priority_conflict', count(*) FROM v_known WHERE known AND hp >= lp UNION ALL SELECT 'pairwise_gap_mismatch', count(*) FROM v_known WHERE known AND gap <> lp - hp
  UNION ALL SELECT 'topk_unknown_demand_id', count(*) FROM v_t ANTI JOIN v_id ON v_t.label = v_id.label AND v_t.t = v_id.id UNION ALL SELECT 'topk_mismatch_vs_priority_labels', count(*) FROM v_w WHERE list_sort(targets) <> urgent
  UNION ALL SELECT 'priority_labels_mismatch_vs_demands', count(*) FROM v_w WHERE labels IS DISTINCT FROM want UNION ALL SELECT 'pairwise_mismatch_vs_demands', count(*) FROM v_w WHERE pairs IS DISTINCT FROM every UNION ALL SELECT 'topk_mismatch_vs_demands', count(*) FROM v_w WHERE targets <> top) WHERE n > 0""")
def ranking_data_audit(spark, d):
    """How often each fault occurs in an hour's windows of ranking data, by one pass over their JSON texts."""
    return quality.audited(windows(spark, d)).filter("place = 1").select("issue", "n")
