"""Queries over dialogues: texts made from demands, what rules read from them, audits, and metrics of the extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylot.functions import extraction
from skylot.functions.scalars import q6
from skylot.operators import ranking
from skylot.operators.matching import greedy_matches
from skylot.operators.metrics import ratio
from skylot.plans.twins import q6 as q
from skylot.plans.twins import with_demand
from skylot.registry import query
from skylot.sources import lens

_SPEAKER = "CASE role WHEN 'emergency_doctor' THEN 'ER Physician' WHEN 'icu_nurse' THEN 'ICU Nurse' WHEN 'consumer' THEN 'Customer' WHEN 'paramedic' THEN 'Paramedic' WHEN 'ward_coordinator' THEN 'Ward Coordinator' ELSE 'Volunteer' END"
_GOODS = "CASE cargo WHEN 'aed' THEN 'an AED' WHEN 'ventilator' THEN 'a ventilator' WHEN 'otc_drug' THEN 'some OTC tablets' WHEN 'vaccine' THEN 'vaccine doses' WHEN 'blood_product' THEN 'one blood product' WHEN 'icu_drug' THEN 'ICU medication' ELSE 'a meal' END"
_CLOCK = "substr(CAST(ts AS STRING), 12, 5)"
_ASKS = {0: "'please send '", 1: "'requesting, by the form, '", 2: "'I am worried, we need '", 3: "'send '"}
#: A dialogue of a demand, in one of four styles.
CONVERSATION = f"""concat('[', {_CLOCK}, '] ', {_SPEAKER}, ': ', CASE k % 4 {' '.join(f'WHEN {i} THEN {a}' for i, a in _ASKS.items())} END, {_GOODS},
  CASE WHEN deadline IS NULL THEN '' WHEN k % 2 = 0 THEN concat(' within ', CAST(deadline AS STRING), ' min') ELSE concat(', at most ', CAST(deadline AS STRING), ' minutes from now') END, '. ', text,
  CASE WHEN children THEN '. A child is involved' ELSE '' END, CASE WHEN elderly AND k % 4 <> 3 THEN '. An elderly neighbour waits' ELSE '' END, CASE WHEN ready THEN '. We can sign for it' ELSE '' END,
  CASE handling WHEN 'cold_chain' THEN '. Keep it insulated' WHEN 'shock_protection' THEN '. Use reinforced brackets' ELSE '' END, '\n[', {_CLOCK}, '] Dispatcher: noted.')"""
_DEFAULTS = {"default_role": "CASE WHEN k % 3 = 0 THEN role END", "default_cargo": "cargo", "default_deadline": "CASE WHEN k % 2 = 0 THEN deadline END"}
_SOURCE = f"(SELECT *, {CONVERSATION} AS conversation, {', '.join(f'{e} AS {c}' for c, e in _DEFAULTS.items())} FROM v_demand)"
_READ = extraction.sql(_SOURCE)


def dialogues(spark, d):
    return lens.demands(spark, d).withColumns({"conversation": extraction.spark(CONVERSATION)} | {c: F.expr(e) for c, e in _DEFAULTS.items()})


def read(spark, d):
    return extraction.extracted(dialogues(spark, d))


@query("rule_dialogues", with_demand(f"SELECT demand_id, conversation FROM {_SOURCE}"))
def rule_dialogues(spark, d):
    return dialogues(spark, d).select("demand_id", "conversation")


@query("heuristic_demand", with_demand(f"SELECT demand_id, {', '.join(extraction.COLUMNS)} FROM {_READ}"))
def heuristic_demand(spark, d):
    """Every field that the rules read from a dialogue, in one pass over it."""
    return read(spark, d).select("demand_id", *extraction.COLUMNS)


@query("conversation_demand", f"""SELECT conv_id, {', '.join(extraction.COLUMNS)} FROM {extraction.sql('''(SELECT conv_id, string_agg('[00:00] ' || coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS conversation,
  CAST(NULL AS VARCHAR) AS default_role, CAST(NULL AS VARCHAR) AS default_cargo, CAST(NULL AS INT) AS default_deadline FROM conversations GROUP BY conv_id)''')}""")
def conversation_demand(spark, d):
    """The same rules on whole conversations, without any metadata to fall back on."""
    line = F.concat(F.lit("[00:00] "), F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = lens.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("turns"))
    rows = turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("conversation"), F.lit(None).cast("string").alias("default_role"),
                        F.lit(None).cast("string").alias("default_cargo"), F.lit(None).cast("int").alias("default_deadline"))
    return extraction.extracted(rows).select("conv_id", *extraction.COLUMNS)


_EVIDENCE = "lower(concat_ws(' ', x_condition, x_sensitivity, x_facility, x_readiness, x_signals, x_handling, x_cargo, x_role))"


@query("text_evidence", with_demand(f"SELECT demand_id, md5({_EVIDENCE}) AS evidence FROM {_READ}"))
def text_evidence(spark, d):
    """The text in which the rule engine looks for evidence: all that was read, joined and in lower case."""
    return read(spark, d).select("demand_id", F.md5(F.expr(_EVIDENCE).cast("binary")).alias("evidence"))


_GOLD = {"cargo": "x_cargo = cargo", "deadline": "x_deadline IS NOT DISTINCT FROM deadline", "tier": "x_tier = tier", "role": "x_role = role", "children": "x_children = children",
         "elderly": "x_elderly = elderly", "handling": "(x_handling = '') = (handling IS NULL)", "destination": "x_destination = destination"}
_ALL = "x_deadline IS NOT DISTINCT FROM deadline AND x_role = role AND x_elderly = elderly AND x_vulnerable = vulnerable"


@query("extraction_quality", with_demand("SELECT count(*) AS n, " + ", ".join(q(f"100 * avg(CASE WHEN {e} THEN 1.0 ELSE 0.0 END)") + f" AS {c}_match" for c, e in {**_GOLD, "critical": _ALL}.items()) + f" FROM {_READ}"))
def extraction_quality(spark, d):
    """Per cent of demands whose field was read as it is, and whose critical fields all were."""
    same = {c: F.expr(e) for c, e in {**_GOLD, "critical": _ALL}.items()}
    return read(spark, d).agg(F.count(F.lit(1)).alias("n"), *(q6(100 * F.avg(F.when(e, 1.0).otherwise(0.0))).alias(f"{c}_match") for c, e in same.items()))


#: A truth that some dialogues miss, and a prediction that some repeat, mistake or invent.
_TRUTH = "k % 10 <> 0"
_KINDS = "CASE WHEN k % 9 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END"


@query("extraction_counts", with_demand(f"""SELECT label, CAST(sum(CASE WHEN t AND n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT t AND n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_scope,
  CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN t AND n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  {q('sum(CASE WHEN t AND n > 0 THEN 1 ELSE 0 END) / nullif(sum(n), 0)::DOUBLE')} AS precision, {q('sum(CASE WHEN t AND n > 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN t THEN 1 ELSE 0 END), 0)::DOUBLE')} AS recall
  FROM (SELECT label, {_TRUTH} AS t, {_KINDS} AS n FROM v_demand) GROUP BY label""", 60))
def extraction_counts(spark, d):
    """Predictions against the truth of their windows: hits, those outside of it, repeated ones, and what was missed."""
    rows = lens.demands(spark, d, 60)
    truth = rows.filter(_TRUTH).select("label", "demand_id", F.lit(True).alias("t"))
    said = rows.withColumn("copies", F.expr(_KINDS)).filter("copies > 0").select("label", F.explode(F.array_repeat("demand_id", F.col("copies"))).alias("demand_id"))
    each = said.groupBy("label", "demand_id").agg(F.count(F.lit(1)).alias("n"))
    both = truth.join(each, ["label", "demand_id"], "full").select("label", F.coalesce("t", F.lit(False)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    hit, windows = F.count_if(F.col("t") & (F.col("n") > 0)), rows.select("label").distinct()
    counts = both.groupBy("label").agg(hit.alias("tp"), F.count_if(~F.col("t") & (F.col("n") > 0)).alias("out_of_scope"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicates"),
                                       F.count_if(F.col("t") & (F.col("n") == 0)).alias("fn"), q6(ratio(hit, F.sum("n"))).alias("precision"), q6(ratio(hit, F.count_if("t"))).alias("recall"))
    return windows.join(counts, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "out_of_scope", "duplicates", "fn")), "precision", "recall")


@query("greedy_matching", with_demand("""SELECT label, CAST(sum(m) AS BIGINT) AS tp, CAST(sum(a - m) AS BIGINT) AS fp, CAST(sum(b - m) AS BIGINT) AS fn FROM (SELECT label, cargo, tier, quantity, a, b, least(a, b) AS m FROM (
  SELECT label, cargo, tier, quantity, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 't') AS b FROM (
  SELECT label, cargo, tier, k % 3 AS quantity, 't' AS side FROM v_demand UNION ALL SELECT label, cargo, tier, (k + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 3, 'p' FROM v_demand WHERE k % 8 <> 0)
  GROUP BY label, cargo, tier, quantity)) GROUP BY label""", 60))
def greedy_matching(spark, d):
    """Each prediction to the first truth of its window that is still free and alike. Without tolerance that is a count."""
    rows = lens.demands(spark, d, 60)
    truth = rows.select("label", "demand_id", "cargo", "tier", (F.col("k") % 3).cast("double").alias("quantity"))
    shifted = (F.col("k") + (F.col("k") % 4 == 0).cast("int")) % 3
    said = rows.filter("k % 8 <> 0").select("label", "demand_id", "cargo", "tier", shifted.cast("double").alias("quantity"))
    return greedy_matches(said, truth, ["label"], ["cargo", "tier"], "quantity", "demand_id", 0.0)


_ID = "coalesce(nullif(trim(event_id), ''), nullif(trim(dialogue_id), ''), {fallback})"


@query("canonical_ids", with_demand(f"""SELECT demand_id, {_ID.format(fallback="'REQ' || lpad(CAST(r AS VARCHAR), 3, '0')")} AS canonical FROM (SELECT demand_id, CASE k % 3 WHEN 0 THEN 'EV' || demand_id WHEN 1 THEN ' ' END AS event_id,
  CASE WHEN k % 5 < 3 THEN 'D' || demand_id ELSE '' END AS dialogue_id, row_number() OVER (PARTITION BY label ORDER BY demand_id) AS r FROM v_demand)"""))
def canonical_ids(spark, d):
    """A demand's id: its event's, else its dialogue's, else its number in the window."""
    rows = ranking.ranked(lens.demands(spark, d), ["label"], ("demand_id",), "r")
    rows = rows.withColumns({"event_id": F.expr("CASE k % 3 WHEN 0 THEN concat('EV', demand_id) WHEN 1 THEN ' ' END"), "dialogue_id": F.expr("CASE WHEN k % 5 < 3 THEN concat('D', demand_id) ELSE '' END")})
    return rows.select("demand_id", F.expr(_ID.format(fallback="concat('REQ', lpad(CAST(r AS STRING), 3, '0'))")).alias("canonical"))


@query("positional_join", with_demand("""SELECT a.demand_id, coalesce(b.v, c.v) AS extracted FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY demand_id) AS r FROM v_demand) a
  LEFT JOIN (SELECT demand_id, score AS v FROM v_demand WHERE k % 3 <> 0) b ON a.demand_id = b.demand_id
  LEFT JOIN (SELECT label, score AS v, row_number() OVER (PARTITION BY label ORDER BY demand_id DESC) AS r FROM v_demand WHERE k % 2 = 0) c ON a.label = c.label AND a.r = c.r""", 60))
def positional_join(spark, d):
    """Extractions by dialogue id, else the one that stands at the same place of the window."""
    rows = lens.demands(spark, d, 60)
    by_id = rows.filter("k % 3 <> 0").select("demand_id", F.col("score").alias("v"))
    by_place = ranking.ranked(rows.filter("k % 2 = 0"), ["label"], ("-demand_id",), "r").select("label", "r", F.col("score").alias("w"))
    placed = ranking.ranked(rows, ["label"], ("demand_id",), "r")
    return placed.join(by_id, "demand_id", "left").join(by_place, ["label", "r"], "left").select("demand_id", F.coalesce("v", "w").alias("extracted"))


@query("metadata_enrichment", with_demand(f"SELECT a.demand_id, coalesce(a.x_role, b.role) AS role, b.destination, b.priority AS latent_priority, b.weight_kg FROM (SELECT demand_id, x_role FROM {_READ} WHERE k % 4 <> 0) a LEFT JOIN (SELECT demand_id, role, destination, priority, weight_kg FROM v_demand WHERE k % 6 <> 0) b ON a.demand_id = b.demand_id"))
def metadata_enrichment(spark, d):
    """Extracted demands with their dialogues' metadata."""
    meta = lens.demands(spark, d).filter("k % 6 <> 0").select("demand_id", "role", "destination", F.col("priority").alias("latent_priority"), "weight_kg")
    rows = read(spark, d).filter("k % 4 <> 0").select("demand_id", "x_role").join(meta, "demand_id", "left")
    return rows.select("demand_id", F.coalesce("x_role", "role").alias("role"), "destination", "latent_priority", "weight_kg")


_POI = {"hospital": "hospital", "clinic": "clinic", "school": "school", "mall": "commercial_area"}


@query("poi_destination", with_demand("SELECT demand_id, CASE WHEN first_poi IN ('hospital', 'clinic', 'school') THEN first_poi WHEN first_poi = 'mall' THEN 'commercial_area' ELSE 'residential_area' END AS dest FROM (SELECT demand_id, CASE WHEN k % 4 = 0 THEN 'hospital' WHEN k % 3 = 0 THEN 'mall' WHEN k % 5 = 0 THEN 'school' END AS first_poi FROM v_demand)"))
def poi_destination(spark, d):
    """The kind of the first known place near by."""
    near = F.array_compact(F.array(F.lit("park"), F.when(F.col("k") % 4 == 0, "hospital"), F.when(F.col("k") % 3 == 0, "mall"), F.when(F.col("k") % 5 == 0, "school")))
    kinds = F.create_map(*(F.lit(x) for kv in _POI.items() for x in kv))
    known = F.filter(F.transform(near, lambda p: F.try_element_at(kinds, p)), lambda k: k.isNotNull())
    return lens.demands(spark, d).select("demand_id", F.coalesce(F.get(known, 0), F.lit("residential_area")).alias("dest"))
