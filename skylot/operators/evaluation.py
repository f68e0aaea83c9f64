"""Predictions against truths that come from several places, extractions against events, and the gates of a release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("auto", "run_extracted", "fixed_demands", "ground_truth_manifest")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by order, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def _named(c: str) -> Column:
    """A name without the spaces round it; null for an empty one."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def aligned(weights: DataFrame, demands: DataFrame, dialogues: DataFrame, truth: DataFrame, source: str = "auto", fixed: DataFrame | None = None) -> DataFrame:
    """weights (time_window, demand_id, priority) with demands (time_window, demand_id, source_event_id, source_dialogue_id,
    observable), dialogues (dialogue_id, event_id) and truth (event_id, latent) -> (time_window, demand_id, event_id,
    true_priority, pred_priority), one row a weight that has all of them. The true priority is by source: auto and
    run_extracted, the demand's observable one; fixed_demands, that of the same demand in fixed (time_window, demand_id,
    observable); ground_truth_manifest, the event's. Where the first is missing the event's counts. A weight without a
    priority predicts 4. Keys of demands, dialogues, truth and fixed are unique (see last_of); weights may repeat."""
    if source not in SOURCES:
        raise ValueError(f"unknown source of truth: {source}")
    if source == "fixed_demands" and fixed is None:
        raise ValueError("fixed_demands needs the fixed demands")
    rows = weights.join(demands, ["time_window", "demand_id"]).withColumn("dialogue_id", _named("source_dialogue_id"))
    rows = rows.join(dialogues.select(_named("dialogue_id").alias("dialogue_id"), _named("event_id").alias("_said")), "dialogue_id", "left")
    rows = rows.withColumn("event_id", F.coalesce(_named("source_event_id"), "_said")).filter("event_id IS NOT NULL")
    rows = rows.join(truth.select(_named("event_id").alias("event_id"), "latent"), "event_id", "left")
    if source == "fixed_demands":
        rows = rows.join(fixed.select("time_window", "demand_id", F.col("observable").alias("_own")), ["time_window", "demand_id"], "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("int") if source == "ground_truth_manifest" else F.col("observable"))
    return rows.select("time_window", "demand_id", "event_id", F.coalesce("_own", "latent").cast("int").alias("true_priority"), F.coalesce("priority", F.lit(4)).cast("int").alias("pred_priority")).filter("true_priority IS NOT NULL")


def matched(said: DataFrame, dialogues: DataFrame, truth: DataFrame, slots: list[int], tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Extracted demands (place, source_event_id, source_dialogue_id, origin, destination, weight) with the events of the dialogues
    (dialogue_id, event_id, slot) of some slots -> each one's (match, hits), and the events (event_id, origin, destination, weight)
    that were to be found. Of those that name one event the first by place, which is unique, is the match (tp); later ones are
    repeated, others lie out of scope, and what names no event is unresolved."""
    asked = dialogues.filter(F.col("slot").isin(*slots)).select(_named("dialogue_id").alias("dialogue_id"), _named("event_id").alias("event_id")).dropna()
    known = truth.select(_named("event_id").alias("event_id"), *(F.col(c).alias(f"true_{c}") for c in ("origin", "destination", "weight")))
    asked = asked.join(known.select("event_id"), "event_id", "left_semi")
    wanted = known.join(asked.select("event_id").distinct(), "event_id")
    rows = said.withColumn("dialogue_id", _named("source_dialogue_id")).join(asked.withColumnRenamed("event_id", "_told"), "dialogue_id", "left")
    rows = rows.withColumn("event_id", F.coalesce(_named("source_event_id"), "_told")).drop("_told")
    # rows without an event meet nothing, and would all go to one task
    rows = rows.withColumn("_spread", F.when(F.col("event_id").isNull(), F.xxhash64("place")).otherwise(F.pmod(F.length("event_id"), F.lit(1)).cast("long")))
    first = rows.filter("event_id IS NOT NULL").groupBy("event_id", "_spread").agg(F.min("place").alias("_first"))
    marked = wanted.withColumns({"_wanted": F.lit(True), "_spread": F.pmod(F.length("event_id"), F.lit(1)).cast("long")})
    rows = rows.join(marked, ["event_id", "_spread"], "left").join(first, ["event_id", "_spread"], "left")
    kind = F.when(F.col("event_id").isNull(), "unresolved").when(F.col("_wanted").isNull(), "out_of_scope").when(F.col("place") == F.col("_first"), "tp").otherwise("duplicate")
    same = lambda c: F.trim(F.col(c).cast("string")) == F.trim(F.col(f"true_{c}").cast("string"))
    hit = {"origin": same("origin"), "destination": same("destination"), "weight": F.abs(F.col("weight") - F.col("true_weight")) <= tolerance}
    rows = rows.withColumn("match", kind)
    return rows.select("place", "event_id", "match", *(((F.col("match") == "tp") & F.coalesce(h, F.lit(False))).alias(f"{c}_hit") for c, h in hit.items())), wanted


def extraction_summary(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """matched() -> one row: counts, precision, recall, F1, and of the matches the share with right fields."""
    rows, wanted = found
    n = lambda m: F.count_if(F.col("match") == m)
    hits = {c: F.count_if(f"{c}_hit") for c in ("origin", "destination", "weight")}
    exact = F.count_if(F.col("origin_hit") & F.col("destination_hit") & F.col("weight_hit"))
    counts = rows.agg(n("tp").alias("tp"), F.count_if(F.col("match") != "tp").alias("fp"), n("duplicate").alias("duplicates"), n("unresolved").alias("unresolved"), n("out_of_scope").alias("out_of_scope"),
                      exact.alias("exact"), *(c.alias(k) for k, c in hits.items()))
    both = counts.crossJoin(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("n_true"))))  # one row each
    over = lambda a, b: F.when(b > 0, a / b)
    both = both.withColumn("fn", F.col("n_true") - F.col("tp"))
    both = both.withColumns({"precision": over(F.col("tp"), F.col("tp") + F.col("fp")), "recall": over(F.col("tp"), F.col("n_true"))})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return both.select("n_true", "tp", "fp", "fn", "duplicates", "unresolved", "out_of_scope", "precision", "recall", f1.alias("f1"),
                       *(over(F.col(c), F.col("tp")).alias(f"{c}_rate") for c in ("exact", "origin", "destination", "weight")))


#: The published gates: (least value, greatest value), and those that the pipeline's and the ranking's data have to pass.
GATES = {"audit_pass_rate": (0.90, None), "priority_1_audit_pass_rate": (0.80, None), "priority_2_audit_pass_rate": (0.80, None), "priority_gap_vs_p4": (None, 0.15),
         "scenario_context_missing_rate": (None, 0.15), "requester_role_missing_rate": (None, 0.05), "requester_role_match_rate": (0.85, None), "surface_contradiction_ratio": (0.10, None),
         "near_tie_ratio": (0.10, None), "surface_contradiction_count": (3.0, None), "near_tie_count": (3.0, None)}
PIPELINE, RANKING = tuple(GATES)[:7], tuple(GATES)[7:]


def gate_checks(dialogues: DataFrame, roles: DataFrame, hard: DataFrame, gates: dict = GATES) -> DataFrame:
    """dialogues (priority, passed, needed array, missing array), roles (expected, observed) of demands whose event is known, and
    hard windows (name) -> (gate, value, low, high, skipped, passed). A gate of a slice without dialogues is skipped, which
    counts as passed. Each table is gone through once."""
    passed, p = F.col("passed"), F.col("priority")
    of = lambda i: (F.count_if(passed & (p == i)).alias(f"ok{i}"), F.count_if(p == i).alias(f"n{i}"))
    asked = F.array_contains("needed", "scenario_context")
    a = dialogues.agg(F.count_if(passed).alias("ok"), F.count(F.lit(1)).alias("n"), *of(1), *of(2), *of(4), F.count_if(asked & F.array_contains("missing", "scenario_context")).alias("lost"), F.count_if(asked).alias("asked"))
    plain = lambda c: F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    seen = plain("observed")
    b = roles.agg(F.count(F.lit(1)).alias("roles"), F.count_if(seen == "").alias("silent"), F.count_if((seen != "") & (seen == plain("expected"))).alias("same"))
    c = hard.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.contains("name", F.lit("surface_contradiction"))).alias("contradictions"),
                 F.count_if(F.contains("name", F.lit("near_tie")) & ~F.contains("name", F.lit("surface_contradiction"))).alias("ties"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    rate = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    r4 = lambda x, y: F.round(rate(x, y), 4)  # noqa: E731  as in the report by priority
    gaps = [F.when((F.col("n4") > 0) & (F.col(f"n{i}") > 0), r4("ok4", "n4") - r4(f"ok{i}", f"n{i}")) for i in (1, 2)]
    value = {"audit_pass_rate": rate("ok", "n"), "priority_1_audit_pass_rate": F.when(F.col("n1") > 0, r4("ok1", "n1")), "priority_2_audit_pass_rate": F.when(F.col("n2") > 0, r4("ok2", "n2")),
             "priority_gap_vs_p4": F.when(F.coalesce(*gaps).isNotNull(), F.greatest(*gaps, F.lit(0.0))), "scenario_context_missing_rate": rate("lost", "asked"),
             "requester_role_missing_rate": r4("silent", "roles"), "requester_role_match_rate": r4("same", "roles"), "surface_contradiction_ratio": r4("contradictions", "windows"),
             "near_tie_ratio": r4("ties", "windows"), "surface_contradiction_count": F.col("contradictions"), "near_tie_count": F.col("ties")}
    rows = [F.struct(F.lit(g).alias("gate"), value[g].cast("double").alias("value"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")) for g, (low, high) in gates.items()]
    v = F.col("value")
    fine = F.coalesce(v >= F.col("low"), F.lit(True)) & F.coalesce(v <= F.col("high"), F.lit(True))
    return one.select(F.inline(F.array(*rows))).select("gate", F.round("value", 4).alias("value"), "low", "high", v.isNull().alias("skipped"), fine.alias("passed"))


def release(checks: DataFrame, clean: DataFrame) -> DataFrame:
    """gate_checks() and the clean windows -> one row: status, the files to train on, and the gates that failed."""
    one = checks.agg(*(F.bool_and(F.col("passed") | ~F.col("gate").isin(*names)).alias(k) for k, names in (("pipeline", PIPELINE), ("ranking", RANKING))),
                     F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failed"))
    one = one.crossJoin(F.broadcast(clean.agg((F.count(F.lit(1)) > 0).alias("clean"))))  # one row each
    ready = F.col("pipeline") & F.col("ranking")
    status = F.when(~F.col("clean"), "debug_only").when(ready, "accepted").otherwise("needs_regen")
    files = [F.when(t, F.lit(n)) for t, n in ((F.col("clean"), "llm3_sft_clean"), (F.col("pipeline"), "llm2_sft"), (F.col("pipeline"), "llm3_sft_pipeline"), (ready, "llm3_grpo_hard"))]
    return one.select(status.alias("status"), F.array_join(F.array_compact(F.array(*files)), ",").alias("files"), "failed")


#: Edits of one field, each (what it is called, where it applies, what it sets).
def counterfactuals() -> dict[str, tuple[Column, dict[str, Column]]]:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "deadline15": (F.coalesce(F.nullif("deadline", F.lit(0)), F.lit(120)) > 15, {"deadline": F.lit(15), "hard": F.lit(True)}),
        "emergency_role": (~F.col("role").eqNullSafe(F.lit("emergency_doctor")), {"role": F.lit("emergency_doctor")}),
        "cold_chain": (~F.col("handling").eqNullSafe(F.lit("cold_chain")), {"handling": F.coalesce("handling", F.lit("cold_chain"))}),
        "not_ready": (yes("ready"), {"ready": F.lit(False)}),
        "vulnerable": (~yes("vulnerable"), {c: F.lit(True) for c in ("vulnerable", "children", "elderly")}),
        "clinic": (~F.coalesce(F.col("destination").isin("hospital", "clinic", "community_health_center"), F.lit(False)), {"destination": F.lit("clinic")}),
    }


def edited(rows: DataFrame) -> DataFrame:
    """rows once for each edit that applies, with variant; a demand that handling has already keeps it and gains the other."""
    edits = counterfactuals()
    spread = rows.withColumn("variant", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, (test, _) in edits.items())))))
    by_column: dict[str, list[tuple[str, Column]]] = {}
    for name, (_, sets) in edits.items():
        for c, v in sets.items():
            by_column.setdefault(c, []).append((name, v))
    return spread.withColumns({c: reduce(lambda w, nv: w.when(F.col("variant") == nv[0], nv[1]), cases, F).otherwise(F.col(c)) for c, cases in by_column.items()})
