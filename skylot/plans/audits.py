"""Queries on what dialogues mention, on records without their answers, and on records laid over one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylot.functions import nested, records
from skylot.functions.scalars import q6
from skylot.operators import factors
from skylot.operators.metrics import ratio
from skylot.plans.extraction import CONVERSATION, dialogues
from skylot.plans.twins import demand, priority, score, with_demand
from skylot.plans.twins import q6 as q
from skylot.registry import query
from skylot.sources import lens

_DUE = records.lookup("priority", records.DEADLINE, "120")


def gold(spark, d):
    """Demands with their dialogues, a deadline each, and their priority by all that is true of them."""
    rows = dialogues(spark, d).withColumn("deadline", F.coalesce("deadline", F.expr(_DUE)))
    return lens.scored(rows)


def audited(spark, d):
    return factors.audited(gold(spark, d).withColumn("handling", F.array_compact(F.array("handling"))))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOLD = "lower(trim(text))"
_KEYS = {
    "scenario_context": f"""list_concat([{_TOLD}], list_filter(list_transform(string_split_regex({_TOLD}, '[.;]| and | before | while '), lambda x: trim(x, ' .,:;')), lambda x: x <> ''),
    list_filter(regexp_extract_all({_TOLD}, '[a-z0-9_]+'), lambda x: length(x) >= 6 AND NOT list_contains({_list(factors.STOP_WORDS)}, x)), {_list(factors.SCENARIO_WORDS)})""",
    "deadline_minutes": "[deadline || ' min', deadline || '-minute', 'within ' || deadline || ' minutes']", "requester_role": "[replace(role, '_', ' ')]",
    "special_handling": f"CASE WHEN handling IS NOT NULL THEN list_concat([handling], {_list(factors.HANDLING_WORDS)}) END", "receiver_ready": f"CASE WHEN ready THEN {_list(factors.READY_WORDS)} END",
    "destination_type": "[replace(destination, '_', ' '), 'receiving point']", "population_vulnerability": f"CASE WHEN children OR elderly THEN {_list(factors.VULNERABLE_WORDS)} END"}
_ALL = (*factors.MUST, *factors.MAY)
_TALK = CONVERSATION.replace("AS STRING", "AS VARCHAR").replace("\\n", "\n")
_FACTORS = f"""{demand()},
v_talk AS (SELECT * EXCLUDE (deadline, score, priority), {CONVERSATION} AS conversation, coalesce(deadline, {_DUE}) AS deadline FROM v_demand),
v_again AS (SELECT *, {score()} AS score FROM v_talk), v_gold AS (SELECT *, {priority()} AS priority FROM v_again),
v_keys AS (SELECT *, trim(regexp_replace(lower(conversation), '\\s+', ' ', 'g')) AS said, {', '.join(f'{e} AS k_{n}' for n, e in _KEYS.items())} FROM v_gold),
v_seen AS MATERIALIZED (SELECT *, {', '.join(f'k_{n} IS NOT NULL AS need_{n}, coalesce(len(list_filter(k_{n}, lambda x: contains(said, x))) > 0, false) AS seen_{n}' for n in _ALL)} FROM v_keys)"""


def _names(which, test: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test.format(n=n)} THEN '{n}' END" for n in which) + ")"


def _count(which, kind: str) -> str:
    return "(" + " + ".join(f"{kind}_{n}::INT" for n in which) + ")"


_MISSING = _names(factors.MUST, "need_{n} AND NOT seen_{n}")
_SCORE = (f"least(1.0::DOUBLE, ({_count(factors.MUST, 'seen')} + {_count(factors.MAY, 'seen')} * 0.5::DOUBLE) / "
          f"greatest({_count(factors.MUST, 'need')} + greatest({_count(factors.MAY, 'need')}, 1) * 0.5::DOUBLE, 1.0::DOUBLE))")


@query("must_mention_factors", f"""WITH {_FACTORS} SELECT demand_id, {_names(factors.MUST, 'need_{n}')} AS must, {_names(factors.MAY, 'need_{n}')} AS may,
  md5(array_to_string(list_sort(list_distinct(list_concat({', '.join(f'coalesce(k_{n}, [])' for n in _ALL)}))), '|')) AS keywords FROM v_seen""")
def must_mention_factors(spark, d):
    """What a dialogue has to and may mention, and the words by which each is told."""
    rows = gold(spark, d).withColumn("handling", F.array_compact(F.array("handling")))
    keys = factors.keywords()
    named = lambda which: F.concat_ws(",", *(F.when(keys[n].isNotNull(), n) for n in which))
    every = F.concat(*(F.coalesce(keys[n], F.array().cast("array<string>")) for n in _ALL))
    return rows.select("demand_id", named(factors.MUST).alias("must"), named(factors.MAY).alias("may"), F.md5(F.array_join(F.sort_array(F.array_distinct(every)), "|").cast("binary")).alias("keywords"))


@query("dialogue_audit", f"WITH {_FACTORS} SELECT demand_id, {q(f'round({_SCORE}, 4)')} AS observability, {_MISSING} AS missing, {_names(_ALL, 'seen_{n}')} AS observed FROM v_seen")
def dialogue_audit(spark, d):
    """Does a dialogue mention the factors of its priority? Optional ones count half."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return audited(spark, d).select("demand_id", q6(F.col("observability")).alias("observability"), joined("missing"), joined("observed"))


#: The demand as it would look if only what is seen were known.
_MASK = {"deadline": "CASE WHEN seen_deadline_minutes THEN deadline ELSE greatest(120, coalesce(nullif(deadline, 0), 120)) END", "hard": "seen_deadline_minutes AND hard",
         "role": "CASE WHEN seen_requester_role THEN role WHEN tier = 'consumer' THEN 'consumer' ELSE 'community_health_worker' END",
         "text": f"CASE WHEN seen_scenario_context THEN text ELSE '{factors.ROUTINE}' END", "handling": "CASE WHEN seen_special_handling THEN handling END", "ready": "seen_receiver_ready AND ready",
         **{c: f"seen_population_vulnerability AND {c}" for c in ("children", "elderly", "vulnerable")}}


def masked(spark, d):
    rows = factors.masked(audited(spark, d).withColumn("whole", F.col("priority")))
    return rows.withColumn("handling", F.element_at(F.when(F.size("handling") > 0, F.col("handling")), 1))


@query("masked_priority", f"WITH {_FACTORS} SELECT demand_id, {', '.join(f'{e} AS m_{c}' for c, e in _MASK.items())} FROM v_seen")
def masked_priority(spark, d):
    """A demand without what its dialogue doesn't show: defaults in place of unobserved factors."""
    return masked(spark, d).select("demand_id", *(F.col(c).alias(f"m_{c}") for c in _MASK))


@query("audit_verdicts", f"""WITH {_FACTORS},
v_mask AS (SELECT demand_id, tier, cargo, destination, priority AS whole, {_MISSING} AS missing, {', '.join(f'{e} AS {c}' for c, e in _MASK.items())} FROM v_seen),
v_judged AS (SELECT *, {score()} AS score FROM v_mask), v_verdict AS (SELECT *, {priority()} AS observable_priority FROM v_judged)
SELECT demand_id, observable_priority, whole, missing = '' AND observable_priority = whole AS passed FROM v_verdict""")
def audit_verdicts(spark, d):
    """An audit is passed if nothing is missing and the masked demand, scored anew, has the priority of the whole one."""
    again = lens.scored(masked(spark, d))
    return again.select("demand_id", F.col("priority").alias("observable_priority"), "whole", ((F.size("missing") == 0) & (F.col("priority") == F.col("whole"))).alias("passed"))


@query("missing_factor_rates", f"WITH {_FACTORS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS factor, count(*) FILTER (need_{n} AND NOT seen_{n}) AS missing, count(*) FILTER (need_{n}) AS needed, {q(f'count(*) FILTER (need_{n} AND NOT seen_{n}) / nullif(count(*) FILTER (need_{n}), 0)::DOUBLE')} AS rate FROM v_seen HAVING count(*) FILTER (need_{n} AND NOT seen_{n}) > 0" for n in factors.MUST))
def missing_factor_rates(spark, d):
    """How often each required factor is missing where it is needed; factors never missing don't appear."""
    must = F.array_intersect("needed", F.array(*map(F.lit, factors.MUST)))
    long = audited(spark, d).select(F.explode(must).alias("factor"), "missing").groupBy("factor").agg(
        F.count_if(F.array_contains("missing", F.col("factor"))).alias("lost"), F.count(F.lit(1)).alias("needed"))
    return long.filter("lost > 0").select("factor", F.col("lost").alias("missing"), "needed", q6(ratio(F.col("lost"), F.col("needed"))).alias("rate"))


_PLACE = "CASE WHEN children AND k % 2 = 0 THEN ' near the school gate' WHEN children THEN ' at the Kindergarten' ELSE '' END"


@query("supplementary_constraints", with_demand(f"""SELECT DISTINCT label, 'noise_avoidance' AS kind, 'Avoid low-altitude flight near P' || user_id || ' because of a nearby school zone.' AS description, {{x}} AS x_mm, {{y}} AS y_mm, 300 AS radius_m
  FROM (SELECT *, lower(text || {_PLACE}) AS evidence FROM v_demand) WHERE contains(evidence, 'school') OR contains(evidence, 'kindergarten')
  UNION SELECT label, 'speed_override', 'Prioritize a direct path for ' || demand_id || ' to reduce thermal exposure.', NULL, NULL, NULL FROM v_demand WHERE handling = 'cold_chain'""", 60).replace(
    "{x}", "user_id * 7919 % 10007").replace("{y}", "user_id * 104729 % 10009"))
def supplementary_constraints(spark, d):
    """A window's flight constraints, equal ones once: quiet zones round schools, direct paths for what has to stay cold."""
    rows = lens.demands(spark, d, 60).withColumns({"evidence": F.lower(F.expr(f"concat(text, {_PLACE})")), "fid": F.concat(F.lit("P"), F.col("user_id").cast("string"))})
    rows = rows.withColumns({"x_mm": F.col("user_id") * 7919 % 10007, "y_mm": F.col("user_id") * 104729 % 10009})
    return constraints(rows).distinct()


def constraints(rows):
    """(label, demand_id, evidence, fid, x_mm, y_mm, handling) -> the constraints that a demand makes, repeated ones too."""
    school = F.contains("evidence", F.lit("school")) | F.contains("evidence", F.lit("kindergarten"))
    quiet = F.struct(F.lit("noise_avoidance").alias("kind"), F.concat(F.lit("Avoid low-altitude flight near "), "fid", F.lit(" because of a nearby school zone.")).alias("description"),
                     "x_mm", "y_mm", F.lit(300).alias("radius_m"))
    direct = F.struct(F.lit("speed_override").alias("kind"), F.concat(F.lit("Prioritize a direct path for "), F.col("demand_id").cast("string"), F.lit(" to reduce thermal exposure.")).alias("description"),
                      F.lit(None).cast("bigint").alias("x_mm"), F.lit(None).cast("bigint").alias("y_mm"), F.lit(None).cast("int").alias("radius_m"))
    return rows.select("label", F.inline(F.array_compact(F.array(F.when(school, quiet), F.when(F.col("handling") == "cold_chain", direct)))))


def order_records(spark, d):
    """Orders with their lines nested, four levels deep, and keys at each that would give an answer away."""
    line = lens.table(spark, d, "lineitem").select("l_orderkey", F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.struct(F.col("l_suppkey").alias("station"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("latent_priority")).alias("state"),
                 F.struct(F.col("l_linestatus").alias("labels")).alias("only_labels")).alias("ship"), F.col("l_tax").alias("urgency")).alias("item"))
    lines = line.groupBy("l_orderkey").agg(F.collect_list("item").alias("demands"))
    order = lens.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("demand_tier"), F.struct(F.col("o_custkey").alias("client"), F.col("o_orderstatus").alias("gold_extraction")).alias("request"),
                                                  F.map_from_arrays(F.array(F.lit("status"), F.lit("priority_labels")), F.array("o_orderstatus", "o_orderpriority")).alias("tags"))
    return order.join(lines, order["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")


@query("leak_sanitizer", """SELECT o_orderkey, o_custkey AS client, 'status=' || o_orderstatus AS tags, string_agg(concat_ws(':', l_linenumber, l_partkey, l_suppkey, l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS items,
  'o_orderkey request{client} tags demands[line part ship{station state{flag}}]' AS fields FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus""")
def leak_sanitizer(spark, d):
    """Ranking inputs without their labels, whatever depth those stand at: the schema is walked, not the values."""
    rows = nested.sanitized(order_records(spark, d), records.LEAKS)
    item = lambda x: F.concat_ws(":", x["line"].cast("string"), x["part"].cast("string"), x["ship"]["station"].cast("string"), x["ship"]["state"]["flag"])
    return rows.select("o_orderkey", F.col("request.client").alias("client"), F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("tags"),
                       F.array_join(F.transform(F.array_sort("demands", _by_line), item), ",").alias("items"), F.lit(_shape(rows.schema)).alias("fields"))


def _by_line(a, b):
    key = lambda x: F.struct(x["line"], x["part"], x["ship"]["station"], x["ship"]["state"]["flag"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _shape(schema) -> str:
    """A schema's field names, nested ones in brackets."""
    kind = lambda t: "{" + _shape(t) + "}" if hasattr(t, "fields") else "[" + _shape(t.elementType) + "]" if hasattr(t, "elementType") and hasattr(t.elementType, "fields") else ""
    return " ".join(f.name + kind(f.dataType) for f in schema.fields)


@query("prefer_nonempty", with_demand("""SELECT demand_id, coalesce(nullif(trim(said_tier), ''), tier) AS demand_tier, coalesce(said_place, destination) AS place, 'N' || user_id AS node, cargo, coalesce(said_cold, handling = 'cold_chain') AS cold,
  coalesce(said_role, role) AS role, said_note AS note, array_to_string(list_filter(['tier ' || tier, CASE WHEN ready THEN 'ready' END, CASE WHEN said_note IS NOT NULL AND NOT (ready AND said_note = 'ready') THEN said_note END], lambda x: x IS NOT NULL), '; ') AS signals FROM (
  SELECT *, CASE WHEN k % 4 = 1 THEN ' ' WHEN k % 4 = 2 THEN 'urgent' END AS said_tier, CASE WHEN k % 3 = 0 THEN 'clinic' END AS said_place, CASE WHEN k % 5 = 0 THEN true END AS said_cold,
  CASE WHEN k % 7 = 0 THEN 'paramedic' END AS said_role, CASE WHEN k % 6 = 0 THEN 'ready' WHEN k % 6 = 1 THEN 'gate closed' END AS said_note FROM v_demand)"""))
def prefer_nonempty(spark, d):
    """A model's record over the rules': its tier where it has one, its structs laid over theirs field by field, and the rules'
    context signals first, the model's behind them."""
    when = lambda test, value: F.when(F.expr(test), value)
    note = when("k % 6 = 0", F.lit("ready")).when(F.expr("k % 6 = 1"), "gate closed")
    listed = lambda *c: F.array_compact(F.array(*c))
    rows = lens.demands(spark, d).select(
        F.struct(F.col("demand_id"), F.col("tier").alias("demand_tier"), F.struct(F.col("destination").alias("type"), F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("node")).alias("destination"),
                 F.struct("cargo", F.coalesce(F.col("handling") == "cold_chain", F.lit(None)).alias("cold")).alias("cargo"), F.struct("role").alias("priority_evaluation_signals"),
                 listed(F.concat(F.lit("tier "), "tier"), when("ready", F.lit("ready"))).alias("context_signals")).alias("rules"),
        F.struct(F.lit("own id").alias("demand_id"), when("k % 4 = 1", F.lit(" ")).when(F.expr("k % 4 = 2"), "urgent").alias("demand_tier"), when("k % 3 <> 1", F.struct(when("k % 3 = 0", F.lit("clinic")).alias("type"))).alias("destination"),
                 F.struct(when("k % 5 = 0", F.lit(True)).alias("cold")).alias("cargo"), F.struct(note.alias("note"), when("k % 7 = 0", F.lit("paramedic")).alias("role")).alias("priority_evaluation_signals"),
                 listed(note).alias("context_signals")).alias("model"))
    one = rows.select(*nested.merged(rows, "model", "rules", prefer=("demand_tier",), overlay=("destination", "cargo", "priority_evaluation_signals"), unite=("context_signals",), keep=("demand_id",)))
    return one.select("demand_id", "demand_tier", F.col("destination.type").alias("place"), "destination.node", "cargo.cargo", "cargo.cold", "priority_evaluation_signals.role", "priority_evaluation_signals.note",
                      F.array_join("context_signals", "; ").alias("signals"))
